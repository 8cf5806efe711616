"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are packed in blocks whose columns are the posting lists of the dimensions. A query block meets every
vector block once: each dimension in which queries are not zero scatters its weighted postings into dense score
arrays; partition selection keeps k of a block, and the k best of all blocks are merged. Query blocks are sent
to all tasks while they are small. Beyond that vector blocks are dealt to groups of bounded size, once, and query blocks
(a few hundredths of the rows) to each group; vectors are never all in one place, and are shuffled once at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block, vectors in a block, bytes of query blocks up to which they are broadcast, and bytes of the
#: vector blocks of a group beyond that.
QUERY_BLOCK = 256
VECTOR_BLOCK = 4096
BROADCAST_BYTES = 32 << 20
GROUP_BYTES = 256 << 20

_MOST = np.iinfo(np.int64).max

_BLOCK = "ids binary, dims int, weights binary"


def _packed(table: pa.Table) -> dict:
    """ids in order, and the weights as one row a dimension; missing dimensions are zeros."""
    ids = np.asarray(table.column(0).combine_chunks().cast(pa.int64()))
    lists = table.column(1).combine_chunks()
    n = np.asarray(lists.value_lengths().fill_null(0))
    dims = int(n.max()) if len(n) else 0
    flat = np.asarray(lists.flatten())
    dense = np.zeros((len(ids), dims), np.int64)
    dense[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat
    order = np.argsort(ids, kind="stable")
    return {"ids": ids[order].tobytes(), "dims": dims, "weights": np.ascontiguousarray(dense[order].T).tobytes()}


def _pack(size: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                p = _packed(pa.Table.from_batches([batch.slice(a, size)]))
                yield pa.RecordBatch.from_pylist([p], pa.schema([("ids", pa.binary()), ("dims", pa.int32()), ("weights", pa.binary())]))

    return run


def _pack_queries(key, table):
    p = _packed(table.select(["id", "weights"]))
    return pa.table({"q": pa.array([key[0].as_py()], pa.int32()), "q_ids": pa.array([p["ids"]], pa.binary()), "q_dims": pa.array([p["dims"]], pa.int32()), "q_weights": pa.array([p["weights"]], pa.binary())})


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def block_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores of every query (columns of q, one row a dimension) and vector (columns of v), dimension by dimension.
    Where 64 bits could be too few, by the largest weights, whole numbers of any size are added up, and scores beyond
    are held at the ends of 64 bits."""
    dims = min(len(q), len(v))
    if dims and _largest(q) * _largest(v) * dims > _MOST:
        wide = sum(np.multiply.outer(q[d].astype(object), v[d].astype(object)) for d in range(dims))
        return np.clip(wide, -_MOST, _MOST).astype(np.int64)
    scores = np.zeros((q.shape[1], v.shape[1]), np.int64)
    for d in range(min(len(q), len(v))):
        some = np.flatnonzero(q[d])
        if len(some) == len(q[d]):
            scores += np.multiply.outer(q[d], v[d])
        elif len(some):
            scores[some] += np.multiply.outer(q[d][some], v[d])
    return scores


def _best(k: int):
    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for r in batch.to_pylist():
                q_ids, ids = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "ids"))
                q = np.frombuffer(r["q_weights"], np.int64).reshape(r["q_dims"], len(q_ids))
                v = np.frombuffer(r["weights"], np.int64).reshape(r["dims"], len(ids))
                scores = block_scores(q, v)
                other = q_ids[:, None] != ids[None, :]
                least = np.iinfo(np.int64).min
                scores[~other] = least
                bar = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q_ids), least)
                for i in range(len(q_ids)):
                    at = np.flatnonzero((scores[i] >= bar[i]) & other[i])
                    at = at[np.lexsort((ids[at], -scores[i][at]))[:k]]
                    out[0].append(np.full(len(at), q_ids[i]))
                    out[1].append(ids[at])
                    out[2].append(scores[i][at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], ["query_id", "id", "score"])

    return run


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds only finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank from 1, id_col, score): each query's k highest integer inner products, ties to the smaller id.

    A component x counts as floor(scale * x). Vectors that are null or hold a null or non-finite component take no
    part, nor do rows whose id is null. Weights and scores beyond 64 bits are held at their ends. Dimensions that one of two vectors lacks count as 0; an empty vector scores
    0. Rows with a query's id are its own and no candidates; of repeated query ids the least vector asks. Other
    repeated rows are candidates each. Fewer than k candidates give fewer rows; no query, or an empty table, none.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    rows = vectors.where(usable(x) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), is_query.alias("_asks"), F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(9.2e18)), F.lit(-9.2e18)))).alias("weights"))
    asks = rows.where("_asks").groupBy("id").agg(F.min("weights").alias("weights"))
    n, total, dims = rows.agg(F.count_distinct(F.when(F.col("_asks"), F.col("id"))), F.count("*"), F.max(F.size("weights"))).first()
    blocks = max(1, -(-n // QUERY_BLOCK))
    queries = asks.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("q").applyInArrow(_pack_queries, "q int, q_ids binary, q_dims int, q_weights binary")
    packed = rows.select("id", "weights").mapInArrow(_pack(VECTOR_BLOCK), _BLOCK)
    if n * (dims or 0) * 8 <= BROADCAST_BYTES:
        met = packed.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(queries), "q")
    else:
        groups = max(1, -(-total * dims * 8 // GROUP_BYTES))
        dealt = packed.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
        met = dealt.join(queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), "g").drop("g")
    best = met.drop("q").mapInArrow(_best(k), "query_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
