"""Labelled training samples of a bounded number of rows, and the fold that labels may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def held_out(id_col: str) -> Column:
    """Whether a document's label is kept from training: crc32 of its id, as text, is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, place, text): of each label at most most[label] rows of the training fold, those whose ids hash
    lowest, with whole texts of any length; place is a hash of the id, to order and to part the sample by.

    The number of rows is the only bound, the same whatever the size of docs; the texts stay with the executors, cut
    in the checkpoint folder. Rows without an id, label or text don't count; of labels given twice the least counts, of
    rows that share an id the least text, and each distinct text is used once.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    once = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    picked = None
    for label, n in sorted(most.items()):
        part = once.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(n)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    first = F.min(F.struct(F.xxhash64("id").alias("place"), "id", "label")).alias("first")
    return cut(rows.groupBy("text").agg(first).select("first.id", F.col("first.label").cast("int").alias("label"), "first.place", "text"))
