"""Source divergence audit: how far the term distributions of a language's sources are from one another, and which terms
set a source apart from its language.

Terms are counted in the tasks that read the texts and summed up. A language's terms are dealt to shards of a bounded
number of counts, its sources to slots. The vectors of a slot's sources in a shard, compressed, stay in their partition;
in the rounds of a tournament copies of half of them travel to the slot they meet, where both directions of each pair
are evaluated. Terms are ranked by a heap in each shard and merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, slices, utf8

#: Bytes of text that are counted at once; counts of a shard, about; slots of a language's sources.
SLICE, CELL, SLOTS = 1 << 22, 1 << 17, 8

#: Groups up to which their totals are broadcast (some 10 MB).
BROADCAST_GROUPS = 100_000

#: Shares are whole numbers of this unit's parts.
UNIT = 1_000_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_TERM = np.zeros(256, bool)
_IS_TERM[65:91] = _IS_TERM[97:123] = _IS_TERM[128:] = True


def shares(counts: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + n_terms)), exact for counts up to 9e15: three digits of the quotient at a time."""
    below = np.int64(total + n_terms)
    rest, out = counts.astype(np.int64) + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + whole
    return out + 1


def _cuts(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, text of each): texts of more than `most` bytes cut before bytes of no term, so that no term is cut."""
    long = np.flatnonzero(np.diff(offsets) > most)
    if not len(long):
        return offsets, np.arange(len(offsets) - 1)
    more = []
    for i in long.tolist():
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > most:
            step = at + most
            while step < end:  # the next byte of no term, a window at a time
                gap = np.flatnonzero(~_IS_TERM[data[step : min(step + 4096, end)]])
                if len(gap):
                    step += int(gap[0])
                    break
                step += 4096
            at = min(step, end)
            if at < end:
                more.append((at, i))
    cuts = np.sort(np.concatenate([offsets, np.array([x for x, _ in more], offsets.dtype)]), kind="stable")
    return cuts, np.repeat(np.arange(len(offsets) - 1), 1 + np.bincount(np.array([i for _, i in more], np.int64), minlength=len(offsets) - 1))


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of the texts that offsets cut data into; of each occurrence, the place of its term and of its text."""
    solid = _IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    where = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    spans = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(_FOLD[data[solid]])])
    coded = spans.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, np.int64), np.searchsorted(offsets, starts, "right") - 1


def _counted(batches):
    """(lang, source, term, n, docs): occurrences, and documents, of each term of each group in a slice of a batch."""
    forget()
    for batch in batches:
        group = pc.binary_join_element_wise(pc.cast(pc.binary_length(batch.column(0)), pa.string()), batch.column(0), batch.column(1), ":").dictionary_encode()
        of_text = np.asarray(group.indices, np.int64)
        _, example = np.unique(of_text, return_index=True)

        def rows(term: pa.Array, g: np.ndarray, n: np.ndarray, docs: np.ndarray):
            at = pa.array(example[g])
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

        data, offsets = utf8(batch.column(2))
        cuts, of_piece = _cuts(data, offsets, SLICE)
        split = np.bincount(of_piece, minlength=len(offsets) - 1) > 1
        met: dict[int, set[str]] = {}  # terms of texts that are cut: a document has each but once
        for a, b in slices(cuts, SLICE):
            terms, code, piece = terms_of(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            text = of_piece[a + piece]
            n_terms = max(1, len(terms))
            pairs, n = np.unique(of_text[text] * n_terms + code, return_counts=True)
            docs = np.zeros(len(pairs), np.int64)
            whole = ~split[text]
            once = np.unique(text[whole] * n_terms + code[whole])
            np.add.at(docs, np.searchsorted(pairs, of_text[once // n_terms] * n_terms + once % n_terms), 1)
            for i in np.unique(text[~whole]).tolist():
                for t in np.unique(code[text == i]).tolist():
                    seen, word = met.setdefault(i, set()), terms[t].as_py()
                    if word not in seen:
                        seen.add(word)
                        docs[np.searchsorted(pairs, of_text[i] * n_terms + t)] += 1
            for i in [i for i in met if i < of_piece[b - 1]]:
                del met[i]  # done with
            yield rows(terms.take(pa.array(pairs % n_terms)) if len(terms) else pa.array([], pa.string()), pairs // n_terms, n, docs)


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): of each group's terms, their occurrences and the documents that hold them; each row is a
    document. A term is a run of ASCII letters and characters beyond ASCII; only A-Z are lower-cased. Nulls count as ''."""
    counted = _texts(docs, text_col, lang_col, source_col).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _packed_vectors(groups: list[tuple[int, int, np.ndarray, np.ndarray]]) -> bytes:
    """Sources of a slot with their totals and sparse counts, compressed: places of terms as steps, then counts."""
    sizes = [(g, total, len(at)) for g, total, at, _ in groups]
    steps = [np.diff(at, prepend=0) for _, _, at, _ in groups]
    flat = np.concatenate([np.array([len(groups), *(x for s in sizes for x in s)], np.int64), *steps, *(n for _, _, _, n in groups)])
    return len(flat).to_bytes(8, "little") + pa.compress(flat.astype("<i8").tobytes(), "zstd", asbytes=True)


def _unpacked_vectors(payload: bytes) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    flat = np.frombuffer(pa.decompress(payload[8:], int.from_bytes(payload[:8], "little") * 8, "zstd", asbytes=True), "<i8")
    k = int(flat[0])
    sizes, at = flat[1 : 1 + 3 * k].reshape(k, 3), 1 + 3 * k
    ends = np.concatenate([[0], np.cumsum(sizes[:, 2])])
    terms, counts = flat[at : at + ends[-1]], flat[at + ends[-1] :]
    return [(int(g), int(total), np.cumsum(terms[a:b]), counts[a:b]) for (g, total, _), a, b in zip(sizes, ends, ends[1:])]


_PACKED = "lang string, shard int, slot int, slots int, terms long, vocabulary long, payload binary, g int, item string, value long"


def _pack(most: int):
    """A shard's counts to the compressed vectors of each slot, and to the first `most` terms of each source."""

    def run(block: pa.Table) -> pa.Table:
        lang, shard, slots, v = (block[c][0].as_py() for c in ("lang", "shard", "slots", "vocabulary"))
        marks = block.filter(pc.is_null(block["term"]))
        totals = sorted(zip(marks["g"].to_pylist(), marks["group_n"].to_pylist()))
        rows = block.filter(pc.is_valid(block["term"]))
        coded = rows["term"].combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        words, code = coded.dictionary, np.asarray(coded.indices, np.int64)
        g, n, lang_n = (np.asarray(rows[c]).astype(np.int64) for c in ("g", "n", "lang_n"))
        out: dict[str, list] = {c: [] for c in ("slot", "payload", "g", "item", "value")}

        def put(*values):
            for held, value in zip(out.values(), values):
                held.append(value)

        order = np.lexsort((code, g))
        g, code, n, lang_n = g[order], code[order], n[order], lang_n[order]
        in_slot: dict[int, list] = {}
        for own, total in totals:
            a, b = np.searchsorted(g, [own, own + 1])
            in_slot.setdefault(own % slots, []).append((own, total, code[a:b], n[a:b]))
            if a == b:
                continue
            p, q = shares(n[a:b], total, v), shares(lang_n[a:b], block["lang_total"][0].as_py(), v)
            over = np.flatnonzero(p > q)
            value = (p - q)[over] ** 2 // q[over]
            if len(value) > most:
                enough = np.flatnonzero(value >= np.partition(value, len(value) - most)[len(value) - most])
                over, value = over[enough], value[enough]
            named = zip((-value).tolist(), (w.encode() for w in words.take(pa.array(code[a:b][over])).to_pylist()))
            for minus, word in heapq.nsmallest(most, named):
                put(None, None, own, word.decode(), -minus)
        for slot, groups in in_slot.items():
            put(slot, _packed_vectors(groups), None, None, None)
        k = len(out["slot"])
        same = [pa.array([x] * k, t) for x, t in ((lang, pa.string()), (shard, pa.int32()))]
        fixed = [pa.array([x] * k, t) for x, t in ((slots, pa.int32()), (len(words), pa.int64()), (v, pa.int64()))]
        own = [pa.array(out["payload"], pa.binary()), pa.array(out["g"], pa.int32()), pa.array(out["item"], pa.string()), pa.array(out["value"], pa.int64())]
        return pa.table([*same, pa.array(out["slot"], pa.int32()), *fixed, *own], names=[f.split()[0] for f in _PACKED.split(", ")])

    return run


def meet(left: list, right: list | None, n_terms: int, vocabulary: int) -> list[tuple[int, int, int]]:
    """(source, other, value) both ways for each pair of left and right (or of left's own), over a shard of n_terms terms: terms
    of neither are summed up in one step."""
    out, other = [], left if right is None else right
    in_b = np.zeros(n_terms, bool)

    def vector(total, n):
        return shares(n, total, vocabulary), int(shares(np.zeros(1), total, vocabulary)[0]) if vocabulary else 1

    shared = [vector(total, n) for _, total, _, n in other]
    for i, (a, total, at, n) in enumerate(left):
        p, p0 = vector(total, n)
        dense = np.full(n_terms, p0, np.int64)
        dense[at] = p
        for (b, _, at_b, _), (q, q0) in list(zip(other, shared))[i + 1 if right is None else 0 :]:
            in_b[at_b] = True
            alone = p[~in_b[at]]
            in_b[at_b] = False
            rest = n_terms - len(alone) - len(at_b)
            apart, apart_alone = (dense[at_b] - q) ** 2, (alone - q0) ** 2
            far = rest * ((p0 - q0) ** 2 // q0) + int((apart // q).sum()) + int((apart_alone // q0).sum())
            back = rest * ((p0 - q0) ** 2 // p0) + int((apart // dense[at_b]).sum()) + int((apart_alone // alone).sum())
            out += [(a, b, far), (b, a, back)]
    return out


def _met(batches):
    """Payloads that meet, or one that meets itself, to (lang, g, other, value)."""
    forget()
    for batch in batches:
        for row in batch.to_pylist():
            guest = _unpacked_vectors(row["guest"]) if row["guest"] is not None else None
            found = meet(_unpacked_vectors(row["payload"]), guest, row["terms"], row["vocabulary"])
            g, other, value = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(g), pa.string()), pa.array(g, pa.int32()), pa.array(other, pa.int32()), pa.array(value, pa.int64())], ["lang", "g", "other", "value"])


def _partner(slot: Column, players: Column, r: int) -> Column:
    """Whom a slot meets in round r of a tournament of an even number of players: the last one stays in its place, the others turn."""
    turning = players - 1
    own = F.pmod(F.lit(2 * r) - slot, turning)
    return F.when(slot == turning, F.pmod(F.lit(r), turning)).otherwise(F.when(own == slot, turning).otherwise(own)).cast("int")


def _tournament(resident: DataFrame) -> DataFrame:
    """(lang, g, other, value) of every shard, for all pairs of a language's sources. Residents stay where they are, the vectors of
    one slot of each meeting go to the other's partition; a round is over, its parts written and its shuffle done with, before the
    next begins."""
    players = F.col("slots") + F.col("slots") % 2
    n_rounds = resident.agg(F.max(players)).first()[0] or 0
    once = F.lit(None).cast("binary").alias("guest")
    out = cut(resident.select("lang", "terms", "vocabulary", "payload", once).mapInArrow(_met, "lang string, g int, other int, value long"))
    for r in range(n_rounds - 1):
        partner = _partner(F.col("slot"), players, r)
        paired = resident.where((players - 1 > r) & (partner < F.col("slots"))).withColumn("partner", partner)
        hosts = F.when((F.col("slot") + F.col("partner")) % 2 == 0, F.col("slot") < F.col("partner")).otherwise(F.col("slot") > F.col("partner"))
        guests = paired.where(~hosts).select("lang", "shard", F.col("partner").alias("slot"), F.col("payload").alias("guest"))
        meetings = resident.join(guests, ["lang", "shard", "slot"]).select("lang", "terms", "vocabulary", "payload", "guest")
        out = out.unionAll(cut(meetings.mapInArrow(_met, "lang string, g int, other int, value long")))
    return out


def audit_sources(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, most_terms: int = 200, slots: int = SLOTS, cell: int = CELL
) -> DataFrame:
    """(lang, source, part, item, value, rank): in the part pair, a language's other sources by how far this one's distribution of
    terms is from theirs, all ranks; in the part term, the terms that set it apart from its language, up to rank most_terms.

    Terms count that least_docs documents of their language or more hold. A share is 1 + floor(UNIT * (count + 1) / (total + terms)), a
    term's value floor((p - q) ** 2 / q), a pair's the sum over all of the language's terms; ties go to the item first in UTF-8. All
    numbers are whole. Null text, lang and source count as ''; each row is a document, whatever its id; a source without terms has
    shares all alike, a language without terms has pairs of value 0 and no terms; a lone source has no pairs. An empty table gives an
    empty one. Other columns are of no account.
    """
    of_term, by_lang = Window.partitionBy("lang", "term"), Window.partitionBy("lang").orderBy("source")
    counts = term_counts(docs, text_col, lang_col, source_col)  # at most a row a source of each term stands in its window
    counts = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("df"), F.sum("n").over(of_term).alias("lang_n"), F.min("source").over(of_term).alias("first"))
    own = cut(counts.where(F.col("df") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("first") == F.col("source")).cast("int").alias("first")))
    # a row a group, and a row a language: as few as the result's, or fewer
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.sum("first").alias("firsts"), F.count(F.lit(1)).alias("k"))
    occurring = _texts(docs, text_col, lang_col, source_col).select("lang", "source").distinct()
    whole = Window.partitionBy("lang")
    groups = occurring.join(totals, ["lang", "source"], "left").select(
        "lang", "source", (F.row_number().over(by_lang) - 1).alias("g"), F.coalesce("group_n", F.lit(0)).alias("group_n"), F.least(F.count(F.lit(1)).over(whole), F.lit(slots)).cast("int").alias("slots"),
        F.coalesce(F.sum("firsts").over(whole), F.lit(0)).alias("vocabulary"), F.coalesce(F.sum("group_n").over(whole), F.lit(0)).alias("lang_total"),
        F.ceil(F.coalesce(F.sum("k").over(whole), F.lit(1)) / cell).cast("int").alias("shards"),
    )
    groups = cut(groups)
    few = F.broadcast if groups.count() <= BROADCAST_GROUPS else lambda x: x
    same = "slots", "vocabulary", "lang_total"
    entries = own.join(few(groups.select("lang", "source", "g", "shards", *same)), ["lang", "source"])
    entries = entries.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "g", "term", "n", "lang_n", F.lit(None).cast("long").alias("group_n"), *same)
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "g", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"), "group_n", *same)
    packed = cut(entries.unionAll(marks).groupBy("lang", "shard").applyInArrow(_pack(most_terms), _PACKED))
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resident = packed.where("payload is not null").select("lang", "shard", "slot", "slots", "terms", "vocabulary", "payload").repartition(parallel, "lang", "shard", "slot").persist()
    pairs = _tournament(resident).groupBy("lang", "g", "other").agg(F.sum("value").alias("value"))
    resident.unpersist()

    name = few(groups.select("lang", "g", "source"))
    pairs = pairs.join(name, ["lang", "g"]).join(few(groups.select("lang", F.col("g").alias("other"), F.col("source").alias("item"))), ["lang", "other"])
    terms = packed.where("payload is null").join(name, ["lang", "g"])
    def ranked(rows: DataFrame, part: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

    # ranks beyond the last one wanted already go before the shuffle
    return ranked(pairs, "pair").unionAll(ranked(terms, "term").where(F.col("rank") <= most_terms))
