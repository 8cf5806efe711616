"""Line dedup: lines whose keys stand in many documents go, the others stay in their order.

DataFrame code alone: lines are exploded and hashed, documents are counted for each hash, places of lines over the
threshold are collected by document, and documents are put together again from the places that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, cut, unused, with_results

#: Keys that are broadcast at most, the most frequent ones (16 bytes each, some 30 MB as a hash table). With more keys over
#: the threshold, what is left stands in less than one of 131,072 lines each, and is joined by a shuffle.
BROADCAST_KEYS = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: separators at both ends stripped, A-Z lower-cased. Null and empty texts have one empty line."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # lower() changes other letters than A-Z only beyond ASCII
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit("".join(map(chr, SEPARATORS)))))


def _hashes(*of: Column) -> tuple[Column, Column]:
    """128 bits, as two 64-bit hashes of different seeds."""
    return F.xxhash64(*of), F.xxhash64(F.lit(1), *of)


def frequent_keys(docs: DataFrame, text_col: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(h1, h2, n_docs): hashes of the keys of least_chars code points or more that least_docs documents or more hold. Each row is a
    document; a key counts once in it, and counts are summed up before they are shuffled, so no key is hot."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(F.col(f"`{text_col}`")))).alias("key")).where(F.char_length("key") >= least_chars)
    h1, h2 = _hashes(F.col("key"))
    return keys.groupBy(h1.alias("h1"), h2.alias("h2")).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least_docs)


def _threshold(frequent: DataFrame, most: int) -> int:
    """The least power of two that at most so many keys reach; 0 if all may be broadcast. Up to 64 numbers come to the driver."""
    of_power = {r["p"]: r["n"] for r in frequent.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, power = 0, 64
    while power > 0 and total + of_power.get(power - 1, 0) <= most:
        power -= 1
        total += of_power.get(power, 0)
    return 1 << power if power else 0


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with n_lines (before), n_dropped and kept_text: its text without the lines whose key, of least_chars code points or
    more, stands in least_docs documents or more; every occurrence goes, the first document's too.

    Each row is a document, whatever its id, so repeated rows count as often as they come and are treated alike. A null text
    counts as empty; an empty text is one empty line, whose key is too short to go unless least_chars is 0. A document that
    loses all lines has an empty kept_text. Null ids are ids. An empty table gives an empty table. Columns of the same names as
    the new ones, in any case, are replaced. Keys are compared by 128 bits of their hashes.

    Only documents' places of dropped lines are joined back; texts are shuffled once, in whole rows.
    """
    text = F.col(f"`{text_col}`")
    k1, k2, gone = unused(docs, "k1", "k2", "gone")
    frequent = cut(frequent_keys(docs, text_col, least_docs, least_chars))
    least = _threshold(frequent, broadcast_keys)
    own = _hashes(F.col(f"`{id_col}`"), text)
    lines = docs.select(own[0].alias("k1"), own[1].alias("k2"), F.posexplode(line_keys(text)).alias("at", "key")).where(F.char_length("key") >= least_chars)
    h1, h2 = _hashes(F.col("key"))
    lines = lines.select("k1", "k2", "at", h1.alias("h1"), h2.alias("h2"))
    hot = F.broadcast(frequent.where(F.col("n_docs") >= least).select("h1", "h2"))  # broadcast_keys at most
    dropped = lines.join(hot, ["h1", "h2"], "left_semi").select("k1", "k2", "at")
    if least:
        rare = frequent.where(F.col("n_docs") < least).select("h1", "h2")
        rest = lines.join(hot, ["h1", "h2"], "left_anti").join(rare.hint("shuffle_merge"), ["h1", "h2"], "left_semi")
        dropped = dropped.unionAll(rest.select("k1", "k2", "at"))
    places = dropped.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("at").alias(gone))
    found = docs.select("*", own[0].alias(k1), own[1].alias(k2)).join(places, [k1, k2], "left")

    text = F.coalesce(text, F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col(gone))
    # the lambda's argument binds the lines, which are then split once
    kept = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(left, lambda i: lines[i]), "\n"))[0]
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    out = with_results(found, n_lines=n_lines.cast("long"), n_dropped=n_dropped.cast("long"), kept_text=F.when(F.col(gone).isNull(), text).otherwise(kept))
    return out.drop(k1, k2, gone)
