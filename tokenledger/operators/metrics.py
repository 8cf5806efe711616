"""Roll-ups: accuracy and tokens, agreement, counts, histograms, curves, fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(flag: Column) -> Column:
    """How large a part of the rows with a verdict is true."""
    return F.avg(flag.cast("int"))


def accuracy_and_tokens(df: DataFrame, *keys: str, verdict: str = "is_correct", tokens: str = "token_count") -> DataFrame:
    """Percentage correct and mean tokens, in all or for each key."""
    return (df.groupBy(*keys) if keys else df).agg((share(F.col(verdict)) * 100).alias("accuracy"), F.avg(tokens).alias("avg_tokens"))


def model_dataset_summary(df: DataFrame, *keys: str, verdict: str = "is_correct", tokens: str = "token_count", hallucinated: str = "hallucinated") -> DataFrame:
    """Numbers of rows, correct rows and hallucinated rows, accuracy, and mean tokens with and without the latter."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_total"), F.count_if(verdict).alias("num_correct"), F.coalesce(F.try_divide(F.count_if(verdict), F.count(F.lit(1))), F.lit(0.0)).alias("accuracy"),
        F.avg(tokens).alias("avg_tokens"), F.avg(F.when(~F.col(hallucinated), F.col(tokens))).alias("avg_tokens_clean"), F.count_if(hallucinated).alias("num_hallucinations"),
    )


def report(summary: DataFrame, datasets: list[str], measures: list[str], row: str = "model", column: str = "dataset") -> DataFrame:
    """One row a model, one column a measure and data set (measure__dataset), in one pass."""
    cells = [F.max(F.when(F.col(column) == d, F.col(m))).alias(f"{m}__{d}") for m in measures for d in datasets]
    return summary.groupBy(row).agg(*cells)


def value_counts(df: DataFrame, column: str, dropna: bool = True, normalize: bool = False) -> DataFrame:
    """(column, n), with share if normalize: how often values occur, null among them unless dropna."""
    kept = df.where(F.col(column).isNotNull()) if dropna else df
    n = kept.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return n
    total = n.agg(F.sum("n").alias("_total"))
    return n.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_total")).alias("share"))  # one row beside all


def unique_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): numbers of distinct values, null not counted."""
    from .prep import unpivot_counts

    return unpivot_counts(df, columns, F.count_distinct)


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, null among them."""
    return df.select(column).distinct()


def largest_groups(df: DataFrame, key: str) -> DataFrame:
    """(key, n): the keys with the most rows."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n").alias("n"))
    return n.join(F.broadcast(top), "n").select(key, "n")


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How often two columns agree, in percent, and their mean signed distance."""
    return pairs.agg((share(F.col(a) == F.col(b)) * 100).alias("agreement"), F.avg(F.col(a) - F.col(b)).alias("distance"))


def selected_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"))


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """How many rows repeat the key of another."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n"))


def bin_of(x: Column, edges: list[float]) -> Column:
    """The place (from 0) of the bin [edge, next edge) of a number, the last bin closed; null outside."""
    out, last = F.lit(None).cast("int"), len(edges) - 2
    for i in range(last, -1, -1):
        upper = x <= edges[i + 1] if i == last else x < edges[i + 1]
        out = F.when((x >= edges[i]) & upper, F.lit(i)).otherwise(out)
    return out


def percentage_histogram(df: DataFrame, column: str, edges: list[float], *keys: str) -> DataFrame:
    """(keys, bin, share): the part of all rows, those outside the edges included, in each bin that has some."""
    binned = df.groupBy(*keys, bin_of(F.col(column), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = binned.groupBy(*keys).agg(F.sum("n").alias("_total"))
    both = binned.join(total, list(keys)) if keys else binned.join(F.broadcast(total))
    return both.where("bin is not null").select(*keys, "bin", (F.col("n") / F.col("_total")).alias("share"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """(bx, by, n): counts in equal bins between each column's extremes, the last closed; rows with a null are out."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    ends = both.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    place = lambda c: F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"lo{c}")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return both.join(F.broadcast(ends)).groupBy(place("x").alias("bx"), place("y").alias("by")).agg(F.count(F.lit(1)).alias("n"))  # ends has one row


def level_curve(df: DataFrame, *keys: str, tokens: str = "actual_tokens", verdict: str = "is_correct") -> DataFrame:
    """Accuracy and mean tokens of each method and level."""
    return df.groupBy(*keys).agg(share(F.col(verdict)).alias("accuracy"), F.avg(tokens).alias("tokens"))


def quadratic_fit(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, c2, c1, c0): the least-squares parabola, from sums of powers; null for fewer than three places."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = points.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("s0"), *(F.sum(F.pow(a, F.lit(i))).alias(f"s{i}") for i in range(1, 5)), F.sum(b).alias("t0"), F.sum(a * b).alias("t1"), F.sum(a * a * b).alias("t2"), F.count_distinct(a).alias("_places"))
    s0, s1, s2, s3, s4, t0, t1, t2 = map(F.col, ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det(m):
        (p, q, r), (u, v, w), (k, n, o) = m
        return p * (v * o - w * n) - q * (u * o - w * k) + r * (u * n - v * k)

    rows = [[s4, s3, s2], [s3, s2, s1], [s2, s1, s0]]
    right = [t2, t1, t0]
    whole = det(rows)
    coefficient = lambda i: F.when(F.col("_places") >= 3, F.try_divide(det([[right[j] if k == i else rows[j][k] for k in range(3)] for j in range(3)]), whole))
    return sums.select(*keys, coefficient(0).alias("c2"), coefficient(1).alias("c1"), coefficient(2).alias("c0"))


def polynomial_fit(points: DataFrame, x: str, y: str, degree: int, *keys: str) -> DataFrame:
    """(keys, coefficients, middle, centred, places): the least-squares polynomial of any degree, its coefficients from the constant
    on, in powers of x, and in powers of x - middle, which don't cancel far from 0; null for fewer different places than
    coefficients. Rows without x or y don't count.

    Places are centred and scaled to -1 .. 1, and sums of Chebyshev polynomials of them, which add up over partitions, give the
    normal equations of an orthogonal basis: T_i T_j is the mean of T_(i+j) and T_|i-j|. One row a key is then solved.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    rows = points.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, own)), F.col(f"`{x}`").cast("double").alias("_x"), F.col(f"`{y}`").cast("double").alias("_y"))
    rows = rows.where("_x is not null and _y is not null")
    ends = rows.groupBy(*own).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count_distinct("_x").alias("places"))
    middle, half = (F.col("_low") + F.col("_high")) / 2, F.greatest((F.col("_high") - F.col("_low")) / 2, F.lit(5e-324))
    ends = ends.select(*(F.col(n).alias(f"{n}e") for n in own), "_low", "_high", "places")
    same = [F.col(n).eqNullSafe(F.col(f"{n}e")) for n in own]
    joined = rows.join(ends, same) if same else rows.join(F.broadcast(ends))  # one row beside all
    scaled = joined.select(*own, "_low", "_high", "places", "_y", ((F.col("_x") - middle) / half).alias("_t"))
    # T_k of t in (-1, 1) is cos(k acos t)
    basis = [F.cos(k * F.acos(F.least(F.greatest("_t", F.lit(-1.0)), F.lit(1.0)))) for k in range(2 * degree + 1)]
    sums = scaled.groupBy(*own, "_low", "_high", "places").agg(F.array(*(F.sum(b) for b in basis)).alias("_s"), F.array(*(F.sum(b * F.col("_y")) for b in basis[: degree + 1])).alias("_r"))

    @F.pandas_udf("coefficients array<double>, centred array<double>")
    def solved(low: pd.Series, high: pd.Series, s: pd.Series, r: pd.Series) -> pd.DataFrame:
        i = np.arange(degree + 1)
        out = []
        for a, b, moments, right in zip(low, high, s, r):
            gram = (moments[i[:, None] + i] + moments[abs(i[:, None] - i)]) / 2
            found = np.linalg.lstsq(gram, right, rcond=1e-13)[0]
            fitted, at = np.polynomial.Chebyshev(found, domain=[a, b] if b > a else [a - 1, a + 1]), (a + b) / 2
            written = (fitted.convert(kind=np.polynomial.Polynomial, domain=domain).coef for domain in ([-1, 1], [at - 1, at + 1]))
            out.append([np.pad(c, (0, degree + 1 - len(c))) for c in written])
        return pd.DataFrame(out, columns=["coefficients", "centred"])

    found = F.when(F.col("places") > degree, solved("_low", "_high", "_s", "_r")).alias("_found")
    return sums.select(*own, middle.alias("middle"), "places", found).select(*(F.col(n).alias(k) for n, k in zip(own, keys)), "_found.coefficients", "middle", "_found.centred", "places")


def curve_points(fits: DataFrame, first: float, last: float, n: int, *keys: str) -> DataFrame:
    """(keys, x, y): n points of each fitted parabola."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(first)) + i * (float(last - first) / (n - 1)))).alias("x")
    return fits.select(*keys, "c2", "c1", "c0", at).select(*keys, "x", (F.col("c2") * F.col("x") * F.col("x") + F.col("c1") * F.col("x") + F.col("c0")).alias("y"))


def matrix_share(matrix: DataFrame, column: str = "y") -> DataFrame:
    """Rows, columns and the part of ones of a matrix of one array a row."""
    ones = F.aggregate(F.col(column), F.lit(0).cast("long"), lambda a, x: a + (x == 1).cast("long"))
    return matrix.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(column)).alias("columns"), F.try_divide(F.sum(ones), F.sum(F.size(column))).alias("share"))


def baselines(matrix: DataFrame, column: str = "y") -> DataFrame:
    """(bin, majority, negative): what always answering the more frequent label gets right, and how often it is 0."""
    long = matrix.select(F.posexplode(column).alias("bin", "v"))
    p = F.avg(F.col("v").cast("double"))
    return long.groupBy("bin").agg(F.greatest(p, 1 - p).alias("majority"), F.avg((F.col("v") == 0).cast("int")).alias("negative"))


def binary_metrics(df: DataFrame, logits: str, y: str, negative: float = 2.5, threshold: float = 0.5) -> DataFrame:
    """(loss, accuracy, tnr) over all bins: weighted cross entropy, share of right labels, share of negatives found
    (null without negatives)."""
    from tokenledger.functions.vectors import sigmoid, sigmoid_loss

    cells = df.select(F.explode(F.arrays_zip(F.col(logits).alias("z"), F.col(y).alias("y"))).alias("c")).select("c.z", "c.y")
    over, label = sigmoid(F.col("z")) > threshold, F.col("y") > 0.5
    return cells.agg(F.avg(sigmoid_loss(F.col("z"), F.col("y"), negative)).alias("loss"), share(over == label).alias("accuracy"), F.try_divide(F.count_if(~label & ~over), F.count_if(~label)).alias("tnr"))


def class_metrics(df: DataFrame, predicted: str, actual: str, n: int) -> DataFrame:
    """(class, n, accuracy) of every class from 0 to n - 1; an empty class is right."""
    grouped = df.groupBy(F.col(actual).alias("class")).agg(F.count(F.lit(1)).alias("n"), share(F.col(predicted) == F.col(actual)).alias("accuracy"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("class"))
    return every.join(grouped, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(1.0)).alias("accuracy"))


def batch_means(df: DataFrame, size: int, *columns: str, position: str = "row_idx") -> DataFrame:
    """Means over batches of `size` positions, and the unweighted mean of these: one row. The last, shorter batch
    weighs as much as any other."""
    batches = df.groupBy(F.floor(F.col(position) / size).alias("batch")).agg(*(F.avg(c).alias(c) for c in columns))
    return batches.agg(*(F.avg(c).alias(c) for c in columns))
