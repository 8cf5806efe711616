"""The budget network: forward passes over tables, and its training where the rows are."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.vectors import dense_layer, sigmoid

from .prep import cut

#: Layer sizes in use: inputs (language model or encoder), hidden layers, bins (one more for the softmax variant).
SHAPES = {"llm": (4096, 1024, 512, 256, 20), "bert": (768, 1024, 512, 256, 20)}
#: Rows of a task of training, at least; sums of gradients that the driver adds up directly.
TASK_ROWS = 512
DIRECT = 16


def forward(layers: list[tuple], x: np.ndarray) -> np.ndarray:
    """Logits of rows: affine layers with what is below 0 cut between them. w is (inputs, outputs)."""
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0)
    w, b = layers[-1]
    return x @ w + b


def logits(df: DataFrame, layers: list[tuple], vector: str, name: str = "logits") -> DataFrame:
    """df with the network's logits, by matrix products in batches; the weights are broadcast (a network is small)."""
    shared = df.sparkSession.sparkContext.broadcast([(np.asarray(w, np.float64), np.asarray(b, np.float64)) for w, b in layers])

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(forward(shared.value, np.stack(v.to_numpy()).astype(np.float64)))) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(name, F.when(F.col(vector).isNotNull(), run(F.coalesce(F.col(vector), F.array(*[F.lit(0.0)] * len(layers[0][0]))))))


def logits_native(x: Column, layers: list[tuple]) -> Column:
    """The same as built-in expressions, for small networks."""
    for i, (w, b) in enumerate(layers):
        by_output = F.array(*(F.array(*(F.lit(float(v)) for v in col)) for col in np.asarray(w).T))
        x = dense_layer(x, by_output, F.array(*(F.lit(float(v)) for v in b)), i < len(layers) - 1)
    return x


def probabilities(z: Column) -> Column:
    return F.transform(z, sigmoid)


def probability_columns(p: Column, bins: list[int]) -> list[Column]:
    """A column named after each bin."""
    return [F.get(p, F.lit(i)).alias(str(b)) for i, b in enumerate(bins)]


def init_network(shape: tuple[int, ...], seed: int = 0) -> list[tuple]:
    """Normal weights of variance 2 / inputs, biases of 0."""
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(shape, shape[1:])]


def _gradients(layers: list, x: np.ndarray, y: np.ndarray, kind: str, dropout: float, negative: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Sums over rows of the loss's gradients, for every w and b in turn."""
    inputs, masks, h = [], [], x.astype(np.float64)
    for i, (w, b) in enumerate(layers):
        inputs.append(h)
        h = h @ w + b
        if i < len(layers) - 1:
            mask = (h > 0) * (rng.random(h.shape) >= dropout) / (1 - dropout)
            masks.append(mask)
            h = h * mask
    if kind == "sigmoid":
        g = (1 / (1 + np.exp(-h)) - y) * np.where(y > 0, 1.0, negative) / y.shape[1]
    else:
        e = np.exp(h - h.max(1, keepdims=True))
        g = e / e.sum(1, keepdims=True) - y
    out: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        out = [inputs[i].T @ g, g.sum(0), *out]
        if i:
            g = (g @ layers[i][0].T) * masks[i - 1]
    return out


def _flat(parts) -> np.ndarray:
    return np.concatenate([np.ravel(p) for p in parts])


def _summed(rows: DataFrame, group: Column) -> DataFrame:
    """(part, n, g) with numbers of rows and gradients summed up by group, in the order of parts."""

    def total(block: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(block["part"]))
        g = np.zeros(len(block["g"][0].as_py()) // 8)
        for i in order.tolist():
            g += np.frombuffer(block["g"][i].as_py())
        return pa.table({"part": [int(block["part"][int(order[0])].as_py())], "n": [int(np.asarray(block["n"]).sum())], "g": pa.array([g.tobytes()], pa.binary())})

    return rows.groupBy(group).applyInArrow(total, "part long, n long, g binary")


def train(samples: DataFrame, shape: tuple[int, ...], kind: str = "sigmoid", vector: str = "hidden", label: str = "y", epochs: int = 140, batch: int = 512, dropout: float = 0.2, rate: float = 1e-4, decay: float = 1e-4, negative: float = 2.5, seed: int = 0) -> list[tuple]:
    """A network trained by AdamW on all rows of samples whose vector and label aren't null.

    kind "sigmoid": label is an array of 0 and 1, zeros weigh `negative`; "softmax": label is a one-hot array.

    Rows stay with the executors, cut in the checkpoint folder and dealt by a hash of their own. Each step broadcasts the
    weights; tasks sum the gradients of their rows of the step's batch, which are added up in groups of tasks (the
    square root of their number) before at most that many sums come to the driver. Rows fall to the batches of an epoch by a hash, so a
    batch has about `batch` rows, and exactly all where these are no more; equal rows fall alike. Reruns agree.
    """
    known = samples.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    known = known.select(F.col(vector).cast("array<float>").alias("x"), F.col(label).cast("array<float>").alias("y"))
    known = known.withColumn("key", F.xxhash64("x", "y"))
    n = known.count()
    layers = [[np.array(w), np.array(b)] for w, b in init_network(shape, seed)]
    if not n:
        return [tuple(x) for x in layers]
    spark = samples.sparkSession
    parts = max(1, min(spark.sparkContext.defaultParallelism * 2, n // TASK_ROWS))
    rows = cut(known.repartition(parts, "key")).persist()
    steps = max(1, round(n / batch))
    moments = [[[np.zeros_like(p), np.zeros_like(p)] for p in layer] for layer in layers]
    sizes, step = [p.size for layer in layers for p in layer], 0
    for epoch in range(epochs):
        for k in range(steps):
            step += 1
            shared = spark.sparkContext.broadcast(layers)

            def gradient(batches, shared=shared, step=step):
                from pyspark import TaskContext

                part, count, total = TaskContext.get().partitionId(), 0, None
                for rows in batches:
                    if rows.num_rows:
                        order = np.argsort(np.asarray(rows.column(2)), kind="stable")
                        x, y = (np.asarray(rows.column(i).flatten()).reshape(rows.num_rows, -1)[order] for i in (0, 1))
                        own = _flat(_gradients(shared.value, x, y, kind, dropout, negative, np.random.default_rng([seed, step, part, count])))
                        total, count = own if total is None else total + own, count + rows.num_rows
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([count], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "g"])

            own = rows.where(F.pmod(F.xxhash64("key", F.lit(epoch), F.lit(seed)), F.lit(steps)) == k) if steps > 1 else rows
            sums = own.mapInArrow(gradient, "part long, n long, g binary")
            groups = int(parts**0.5)
            found = sorted((_summed(sums, F.col("part") % groups) if parts > DIRECT else sums).collect())  # DIRECT sums, or the root of more
            shared.unpersist()
            if not found:
                continue
            mean = sum(np.frombuffer(r["g"]) for r in found) / sum(r["n"] for r in found)
            for i, d in enumerate(np.split(mean, np.cumsum(sizes)[:-1])):
                i, j = divmod(i, 2)
                m, v = moments[i][j]
                d = d.reshape(m.shape)
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                layers[i][j] = layers[i][j] * (1 - rate * decay) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    rows.unpersist()
    return [tuple(layer) for layer in layers]
