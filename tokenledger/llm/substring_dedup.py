"""Substring deduplication with a count-min prefilter.

Each word that a repeated window covers goes, except in the first document (by id) that has the window.
Every window of every document takes part:

1. Documents are dealt to chunks by hash, copies included, so that one text held by a third of all rows is spread. Each
   chunk builds a partition sketch, the count-min counters that its distinct windows raise by one (a cell in each of
   the sketch's rows), and sends each block of the sketch its part: sorted cells, as 2-byte gaps.
2. Each block adds the partition sketches up. The least counter of a window is its estimate: in how many chunks it
   occurs, never too low. One bit for each counter a chunk raised goes back to it: whether it stands at 2 or more.
3. Only windows all of whose counters do leave their chunk, once a chunk and with the smallest id there; they are
   grouped exactly by 128 bits: two 64-bit hashes that share nothing, of word hashes with different seeds (among 1e13
   windows some two agree by chance with a probability of 2e-13). One bit each goes back: a smaller id has this
   window elsewhere. Windows with an estimate of 1 occur in their chunk alone, which decides them itself. None is lost.

There are as many blocks as chunks. A chunk has 4 MB of text, from 37 GB on more, as the square root of the input
(20 MB at 1 TB, 200 MB at 100 TB), so that a message has some 64 counters or more at any size: 4 bytes a window are
sent, in 2.5e9 messages at 1 TB; and 20 bytes for a window in several chunks. Texts are shuffled once (the exchange is
reused).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _WORD_STEPS, GAP, forget, mix, n_words, slices, unused, utf8, window_hashes, with_fields, with_results, word_hashes, word_spans

#: Bytes of text in a chunk at least, and by how many bytes of input the square of a chunk's bytes grows.
CHUNK_BYTES = 4 << 20
MESSAGE_BYTES = 430
#: Rows of the count-min sketch; counters of a row that are added up at once.
SKETCH_DEPTH = 2
SKETCH_SLICE = 1 << 22
#: Words that are hashed at once, in whole documents.
HASHED_WORDS = 1 << 16

_ROW_STEP = 0x9E3779B97F4A7C15
_REPLY = "chunk int, kind int, block int, bits binary"


class _Sketch:
    """Sizes that all chunks and blocks share: words of a window, blocks, and the counters of a block's rows."""

    def __init__(self, size: int, blocks: int, width: int, depth: int):
        self.size, self.blocks, self.width, self.depth = size, blocks, width, depth

    def cells(self, h1: np.ndarray) -> Iterator[np.ndarray]:
        """The counter of each window in each row: its block, then its place in the block."""
        key = mix(h1)
        block = ((key >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        places = (mix(key ^ np.uint64((row + 1) * _ROW_STEP % 2**64)) & np.uint64(self.width - 1) for row in range(self.depth))
        return (block * np.uint64(self.width) + place for place in places)

    def split(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of distinct cells in order, and the bounds of their runs."""
        block = (cells // np.uint64(self.width)).astype(np.int64)
        cuts = _split(block)
        return block[cuts[:-1]], cuts


def _packed(places: np.ndarray) -> bytes:
    """Rising numbers as gaps of 2 bytes, or, where a gap is too wide, as they are in 4."""
    gaps = np.diff(places, prepend=0)
    return gaps.astype("<u2").tobytes() if gaps.max(initial=0) < 1 << 16 else places.astype("<u4").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u2"), dtype=np.int64) if len(raw) == 2 * n else np.frombuffer(raw, "<u4").astype(np.int64)


class _Chunk:
    """The windows of a chunk's documents, in an order that does not depend on how rows arrived."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, sketch: _Sketch):
        table = table.combine_chunks().sort_by([(id_col, "ascending"), (text_col, "ascending")])
        self.table, self.sketch = table, sketch
        self.ids = np.asarray(table.column(id_col).combine_chunks().cast(pa.int64()))
        self.data, self.offsets = utf8(table.column(text_col))
        self.starts, self.ends, self.before = word_spans(self.data, self.offsets)
        place = np.int32 if len(self.data) < 1 << 31 else np.int64
        self.starts, self.ends = self.starts.astype(place), self.ends.astype(place)
        counts = np.diff(self.before)
        windows = np.maximum(counts - sketch.size + 1, 0)
        self.doc = np.repeat(np.arange(len(counts), dtype=place), windows)
        self.begun = np.r_[0, np.cumsum(windows)]
        self.at = np.arange(self.begun[-1], dtype=place)
        self.at += np.repeat((self.before[:-1] - self.begun[:-1]).astype(place), windows)
        self.h1 = self.hashes(0)

    def hashes(self, kind: int) -> np.ndarray:
        out = np.empty(len(self.at), np.uint64)
        for first, beyond in slices(self.before, HASHED_WORDS):
            a, b, low, high = *self.before[[first, beyond]].tolist(), *self.begun[[first, beyond]].tolist()
            if high > low:
                begin, end = int(self.starts[a]), int(self.ends[b - 1])
                words = word_hashes(self.data[begin:end], self.starts[a:b] - begin, self.ends[a:b] - begin, kind)
                out[low:high] = window_hashes(words, _WORD_STEPS[kind], self.at[low:high] - a, self.sketch.size)
        return out

    def exact(self, of: np.ndarray | None, h2: np.ndarray):
        """Windows `of` (None: all) grouped by all 128 bits: the group of each; of each group its bits, smallest id and block."""
        h1, h2 = (self.h1, h2) if of is None else (self.h1[of], h2[of])
        order = np.argsort(h1, kind="stable")  # rows stand in order of id, so a group's first has its smallest
        new = np.ones(len(h1), bool)
        one, other = h1[order], h2[order]
        new[1:] = one[1:] != one[:-1]
        if np.any((other[1:] != other[:-1]) & ~new[1:]):
            order = np.lexsort((h2, h1))
            one, other = h1[order], h2[order]
            new[1:] = (one[1:] != one[:-1]) | (other[1:] != other[:-1])
        del one, other
        group = np.empty(len(h1), self.at.dtype)
        group[order] = np.cumsum(new, dtype=group.dtype) - 1
        firsts = order[new]
        del order, new
        block = ((mix(h2[firsts]) >> np.uint64(32)) * np.uint64(self.sketch.blocks)) >> np.uint64(32)
        return group, h1[firsts], h2[firsts], self.ids[self.doc[firsts if of is None else of[firsts]]], block.astype(np.int64)


def _split(block: np.ndarray):
    """Bounds of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, np.int64)


def _sketches(id_col, text_col, sketch):
    """A chunk's partition sketch: for each block the cells that its windows raise, row after row."""

    def run(key, table):
        forget()
        c = _Chunk(table, id_col, text_col, sketch)
        parts: dict[int, list] = {}
        for row, cells in enumerate(sketch.cells(c.h1)):
            cells = np.unique(cells)
            blocks, cuts = sketch.split(cells)
            places = (cells % np.uint64(sketch.width)).astype(np.int64)
            for block, a, b in zip(blocks.tolist(), cuts[:-1], cuts[1:]):
                parts.setdefault(block, []).append((_packed(places[a:b]), int(b - a)))
        return pa.table({
            "block": pa.array(list(parts), pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()),
            "cells": pa.array([[p for p, _ in rows] for rows in parts.values()], pa.list_(pa.binary())),
            "n": pa.array([[n for _, n in rows] for rows in parts.values()], pa.list_(pa.int32())),
        })

    return run


def _merge(sketch):
    """Adds the partition sketches of a block up, and tells every chunk which of its counters stand at 2 or more."""

    def run(key, table):
        cells, n = table.column("cells").to_pylist(), np.array(table.column("n").to_pylist(), np.int64).reshape(-1, sketch.depth)
        again = []
        for row in range(sketch.depth):
            places = np.concatenate([_unpacked(part[row], k) for part, k in zip(cells, n[:, row])])
            found = np.zeros(len(places), bool)
            for low in range(0, sketch.width, SKETCH_SLICE):
                at = np.flatnonzero((places >= low) & (places < low + SKETCH_SLICE)) if sketch.width > SKETCH_SLICE else slice(None)
                own = places[at] - low
                found[at] = np.bincount(own, minlength=1)[own] >= 2
            again.append(np.split(found, np.cumsum(n[:-1, row])))
        bits = [np.packbits(np.concatenate(rows)).tobytes() for rows in zip(*again)]
        return pa.table({"chunk": table.column("chunk").cast(pa.int32()), "kind": pa.array([0] * len(bits), pa.int32()), "block": pa.array([key[0].as_py()] * len(bits), pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _replies(table: pa.Table, kind: int) -> dict[int, bytes]:
    """What came back to a chunk, by block."""
    return {b: x for k, b, x in zip(*(table.column(c).to_pylist() for c in ("kind", "block", "bits"))) if k == kind}


def _estimated(c: _Chunk, replies: pa.Table) -> np.ndarray:
    """Which windows of the chunk are estimated to occur in other chunks too: those all of whose counters say so."""
    got, out, skip = _replies(replies, 0), np.ones(len(c.at), bool), {}
    for cells in c.sketch.cells(c.h1):
        cells, back = np.unique(cells, return_inverse=True)
        bits = np.zeros(len(cells), bool)
        blocks, cuts = c.sketch.split(cells)
        for block, a, b in zip(blocks.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            first = skip.get(block, 0)
            skip[block] = first + b - a
            bits[a:b] = np.unpackbits(np.frombuffer(got[block], np.uint8), count=first + b - a)[first:]
        out &= bits[back]
    return out


def _requests(id_col, text_col, sketch):
    def run(key, docs, replies):
        c = _Chunk(docs, id_col, text_col, sketch)
        of = np.flatnonzero(_estimated(c, replies))
        _, h1, h2, ids, block = c.exact(of, c.hashes(1))
        order = np.argsort(block, kind="stable")
        cuts = _split(block[order])
        rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({
            "block": pa.array([int(block[r[0]]) for r in rows], pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "h1": pa.array([h1[r].tobytes() for r in rows], pa.binary()),
            "h2": pa.array([h2[r].tobytes() for r in rows], pa.binary()),
            "ids": pa.array([ids[r].tobytes() for r in rows], pa.binary()),
        })

    return run


def _group_exactly(key, table):
    parts = [np.frombuffer(x, np.uint64) for x in table.column("h1").to_pylist()]
    h1 = np.concatenate(parts)
    h2 = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("h2").to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    order = np.lexsort((h2, h1))
    new = np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    later = np.empty(len(ids), bool)
    later[order] = least[np.cumsum(new) - 1] < ids[order]
    cuts = np.cumsum([0, *map(len, parts)])
    n = len(parts)
    return pa.table({"chunk": table.column("chunk").cast(pa.int32()), "kind": pa.array([1] * n, pa.int32()), "block": pa.array([key[0].as_py()] * n, pa.int32()), "bits": pa.array([np.packbits(later[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _remove(id_col, text_col, sketch, names):
    def run(key, docs, replies):
        c = _Chunk(docs, id_col, text_col, sketch)
        goes = np.zeros(len(c.at), bool)
        if len(c.at):
            h2 = c.hashes(1)
            # within the chunk: a smaller id has the window
            group, _, _, least, _ = c.exact(None, h2)
            goes = c.ids[c.doc] > least[group]
            del group, least
            of = np.flatnonzero(_estimated(c, replies))
            if len(of):
                group, _, _, _, block = c.exact(of, h2)
                order = np.argsort(block, kind="stable")
                cuts, got = _split(block[order]), _replies(replies, 1)
                bits = np.empty(len(block), bool)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    bits[order[a:b]] = np.unpackbits(np.frombuffer(got[int(block[order[a]])], np.uint8), count=b - a).astype(bool)
                goes[of] |= bits[group]
                del group, block, order, bits
            del h2, of
        step = np.zeros(len(c.starts) + 1, np.int64)
        np.add.at(step, c.at[goes], 1)
        np.add.at(step, c.at[goes] + sketch.size, -1)
        kept = np.cumsum(step[:-1]) == 0
        raw = c.data.tobytes()
        texts, counts = [], np.diff(c.before)
        removed = counts - np.diff(np.r_[0, np.cumsum(kept)][c.before])
        for i, (a, b) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist())):
            words = raw[a:b].split()
            texts.append(b" ".join(compress(words, kept[c.before[i] : c.before[i + 1]].tolist()) if removed[i] else words))
        new = {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())}
        return pa.table({n: new[n] if n in new else c.table.column(n) for n in names})

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, chunk_bytes: int = CHUNK_BYTES, width: int | None = None, depth: int = SKETCH_DEPTH) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the words left, joined by one space) for every row.

    A word goes if one of the windows of `size` words over it also starts in a row with a smaller id. Words are
    compared as bytes; texts may be of any length (a chunk holds one text at least). Null texts have no words; rows
    with a null id neither lose words nor take any; rows with equal ids don't take words from one another (a repeat
    inside one document stays), so repeated rows come back alike. Columns of docs named like a result are replaced,
    all others stay. An empty table gives an empty table. Ids are whole numbers.

    width: counters of a row of a sketch block, a power of 2; by default about six for each window of a chunk.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunk_bytes = max(chunk_bytes, int((MESSAGE_BYTES * total) ** 0.5))
    chunks = max(1, -(-total // chunk_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sketch = _Sketch(size, chunks, width or 1 << max(16, (-(-total // chunks)).bit_length()), depth)
    names = {"n_words", "n_removed", "kept_text"}
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c in (id_col, text_col) or c.lower() not in names))
    chunk = unused(docs, "chunk")
    dealt = docs.where(F.col(id_col).isNotNull()).withColumn(chunk, F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int"))
    by_chunk = dealt.groupBy(chunk)
    sketches = by_chunk.applyInArrow(_sketches(id_col, text_col, sketch), "block int, chunk int, cells array<binary>, n array<int>")
    estimates = sketches.groupBy("block").applyInArrow(_merge(sketch), _REPLY)
    requests = by_chunk.cogroup(estimates.groupBy("chunk")).applyInArrow(_requests(id_col, text_col, sketch), "block int, chunk int, h1 binary, h2 binary, ids binary")
    verdicts = requests.groupBy("block").applyInArrow(_group_exactly, _REPLY)
    schema = with_fields(docs, ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()))
    known = by_chunk.cogroup(estimates.unionAll(verdicts).groupBy("chunk")).applyInArrow(_remove(id_col, text_col, sketch, schema.names), schema)
    lone = with_results(docs.where(F.col(id_col).isNull()), n_words=n_words(F.col(text_col)), n_removed=F.lit(0).cast("long"), kept_text=F.coalesce(F.btrim(F.regexp_replace(text_col, GAP, " "), F.lit(" ")), F.lit("")))
    return known.unionAll(lone)
