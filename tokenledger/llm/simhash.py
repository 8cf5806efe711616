"""SimHash near-duplicate detection with pigeonhole blocks.

A fingerprint is cut into m blocks; two that differ in at most d bits agree in at least m - d of them, so each
distinct fingerprint goes under one key for every choice of m - d blocks, and close pairs meet under some key.
Keys are dealt by hash; in a task, sorted by key, candidates are verified by Hamming distance, and of each
cluster only a star of links leaves the task, never all its pairs. m grows with the number of distinct
fingerprints, which keeps unrelated fingerprints under one key few; any m finds every pair.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, slices, unused, utf8, with_fields, word_spans
from .components import smallest_reachable

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Distinct fingerprints under one key that are compared with one another directly.
DIRECT = 1024
#: Keys of fingerprints that one task sorts, on average.
TASK_KEYS = 2_000_000


def majority_bits(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The 64 majority bits of each text's n hashes, which stand in h one text after the other; 0 for none."""
    # eight counters in the bytes of a word, over runs of at most 255 hashes
    begun, low = np.cumsum(n) - n, np.uint64(0x0101010101010101)
    runs = np.concatenate([np.arange(a, a + k, 255) for a, k in zip(begun.tolist(), n.tolist()) if k] or [np.zeros(0, np.int64)]).astype(np.int64)
    run_doc = np.repeat(np.arange(len(n)), -(-n // 255))
    total = np.zeros((len(n), 64), np.int64)
    for shift in range(8):
        packed = np.add.reduceat((h >> np.uint64(shift)) & low, runs)
        eight = packed[:, None].view(np.uint8).reshape(len(runs), 8).astype(np.int64)
        np.add.at(total, (run_doc[:, None], np.arange(8)[None, :] * 8 + shift), eight)
    return np.packbits(total * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """The 64-bit SimHash of each text: majority bits of the XXH64 of its word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    data = _LOWER[data]
    out = np.zeros(len(offsets) - 1, np.uint64)
    for first, beyond in slices(offsets, 1 << 20):
        part = offsets[first : beyond + 1] - offsets[first]
        own = data[offsets[first] : offsets[beyond]]
        starts, ends, before = word_spans(own, part)
        if not len(starts):
            continue
        # the words with one space between, in one stream
        sizes = ends - starts
        at = np.cumsum(sizes + 1) - (sizes + 1)
        stream = np.full(int(sizes.sum() + len(sizes)), 32, np.uint8)
        source = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        stream[np.repeat(np.arange(len(sizes)), sizes) + np.arange(sizes.sum())] = own[source]
        stream = stream.tobytes()
        words = np.diff(before)
        n = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
        begun = np.cumsum(n) - n
        head = np.arange(n.sum()) - np.repeat(begun, n) + np.repeat(before[:-1], n)
        tail = head + np.repeat(np.minimum(words, shingle), n) - 1
        h = np.array([xxh64_intdigest(stream[a:b], seed) for a, b in zip(at[head].tolist(), (at[tail] + sizes[tail]).tolist())], np.uint64)
        out[first:beyond] = majority_bits(h, n)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4, seed: int = 42, name: str = "simhash") -> DataFrame:
    """docs with a column, simhash unless named otherwise (long: the 64 bits). A-Z count as a-z; a text with fewer words than a shingle is one
    shingle; a text without words, empty or null, has 0. A column of that name is replaced."""
    schema = with_fields(docs, (name, T.LongType()))
    names = schema.names

    def run(batches):
        forget()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            h = text_fingerprints(*utf8(column), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h) if n == name else batch.column(batch.schema.get_field_index(n)) for n in names], names)

    return docs.mapInArrow(run, schema)


def _masks(blocks: int, bits: int) -> list[int]:
    """A mask for each choice of blocks - bits of the blocks of a fingerprint."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(own[i] for i in chosen) for chosen in combinations(range(blocks), blocks - bits)]


def _blocks_for(distinct: int, bits: int) -> int:
    """The fewest blocks for which unrelated fingerprints seldom share a key."""
    for blocks in range(bits + 1, 65):
        if distinct <= 4 * 2 ** (64 * (blocks - bits) // blocks) or comb(blocks + 1, bits) > 200:
            return blocks
    return 64


def star_links(f: np.ndarray, bits: int, find: dict | None = None) -> dict[int, int]:
    """Distinct fingerprints f (uint64) united where they differ in at most `bits` bits: a union-find forest.

    Few are compared directly; more are dealt by bits + 1 blocks of 64 bits and compared block by block, but for
    sets that are united already. A set that no block splits is compared in strips.
    """
    parent = find if find is not None else {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    def unite(a, b):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    def direct(part):
        for i in range(0, len(part), DIRECT):
            strip = part[i : i + DIRECT]
            for j in range(i, len(part), DIRECT):
                other = part[j : j + DIRECT]
                a, b = np.nonzero(np.bitwise_count(strip[:, None] ^ other[None, :]) <= bits)
                keep = a + i < b + j
                for x, y in zip(strip[a[keep]].tolist(), other[b[keep]].tolist()):
                    unite(x, y)

    if len(f) <= DIRECT:
        direct(f)
        return parent
    # neighbours in order first: most of a large cluster unites here
    near = np.bitwise_count(f[1:] ^ f[:-1]) <= bits
    for x, y in zip(f[:-1][near].tolist(), f[1:][near].tolist()):
        unite(x, y)
    for mask in _masks(bits + 1, bits):
        own = f & np.uint64(mask)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a < 2:
                continue
            part = f[order[a:b]]
            if len({root(x) for x in part.tolist()}) > 1:
                direct(part)
    return parent


def _links(bits: int):
    def run(batches):
        held: list[pa.Table] = []

        def linked(key: np.ndarray, f: np.ndarray):
            order = np.lexsort((f, key))
            key, f = key[order], f[order]
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            n = np.diff(cuts)
            a, b = [], []
            # groups of a few, all at once: each with those up to 7 places on
            small = np.repeat(n <= 8, n)
            for d in range(1, 8):
                same = small[d:] & (key[d:] == key[:-d])
                at = np.flatnonzero(same & (np.bitwise_count(f[d:] ^ f[:-d]) <= bits))
                a.append(f[at + d])
                b.append(f[at])
            for g in np.flatnonzero(n > 8).tolist():
                forest = star_links(np.unique(f[cuts[g] : cuts[g + 1]]), bits)
                pairs = []
                for x in forest:
                    r = x
                    while forest.get(r, r) != r:
                        r = forest[r]
                    if r != x:
                        pairs.append((x, r))
                if pairs:
                    pairs = np.array(pairs, np.uint64)
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
            a, b = (np.concatenate(x).astype(np.uint64).view(np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if batch.column(0)[0] == batch.column(0)[-1] == held[0].column(0)[-1]:
                continue  # one key goes on
            t = pa.concat_tables(held)
            key, f = (np.asarray(t.column(i).combine_chunks()) for i in (0, 1))
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            held = [t.slice(whole)]
            if whole:
                yield linked(key[:whole], f[:whole].view(np.uint64))
        if held:
            t = pa.concat_tables(held)
            key, f = (np.asarray(t.column(i).combine_chunks()) for i in (0, 1))
            yield linked(key, f.view(np.uint64))

    return run


def link_fingerprints(distinct: DataFrame, count: int, bits: int = 4) -> DataFrame:
    """Links (a, b) that join the same components as all pairs of fingerprints at `bits` or fewer differing bits.

    distinct: one column simhash, without repeats; count: its rows.
    """
    masks = _masks(_blocks_for(count, bits), bits)
    keyed = distinct.select("simhash", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("simhash").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")).alias("part")) for i, m in enumerate(masks)))).alias("k"))
    keyed = keyed.select(F.xxhash64("k.i", "k.part").alias("key"), "simhash")
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * len(masks) // TASK_KEYS))
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(bits), "a long, b long")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """(id, simhash, component_id) for every row: the smallest id reachable over links, itself included.

    Rows with equal fingerprints are linked, texts without words (fingerprint 0) included. Rows with a null id
    link others but give no component_id, which is null where a component has no id at all. Repeated rows
    come back as often as they came. Texts may be of any length. Other columns of docs don't come back. An empty
    table gives an empty table.
    """
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle, seed).select("id", "simhash"))
    nodes = cut(prints.groupBy("simhash").agg(F.min("id").alias("label")))
    links = link_fingerprints(nodes.select("simhash"), nodes.count(), bits)
    found = smallest_reachable(nodes.select(F.col("simhash").alias("node"), "label"), links)
    labels = nodes.join(found.select(F.col("node").alias("simhash"), F.col("label").alias("least")), "simhash", "left").select("simhash", F.coalesce("least", "label").alias("component_id"))
    labels = cut(labels)  # then both sides of the last join are plain exchanges, and a fingerprint of many rows is split
    return prints.join(labels, "simhash", "left").select(F.col("id").alias(id_col), "simhash", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each component: that with the smallest id (of rows that share it, that with the least text).

    Rows with a null id stay only where their whole component has no id. Columns are those of docs, whatever their
    names. An empty table gives an empty table.
    """
    found = near_duplicate_components(docs, id_col, text_col, **options)
    own = unused(docs, "print")
    orphans = found.where("component_id is null").select(F.col("simhash").alias(own)).distinct()
    lone = fingerprints(docs.where(F.col(id_col).isNull()), text_col, options.get("shingle", 4), options.get("seed", 42), own)
    lone = lone.join(orphans, own).drop(own).select(*(f"`{c}`" for c in docs.columns))
    return rows_of_components(docs, found, lone, id_col, text_col)


def rows_of_components(docs: DataFrame, found: DataFrame, lone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of docs with the smallest id of each component of found, and the rows of lone."""
    keep, rank = unused(docs, "keep", "rank")
    ids = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(keep)).distinct()
    # a short list of ids beside the texts: the texts alone are shuffled once, by id
    kept = docs.join(ids, docs[id_col] == ids[keep]).drop(keep)
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last()))
    return kept.withColumn(rank, first).where(F.col(rank) == 1).drop(rank).unionAll(lone)
