"""Arrays of numbers: grids, networks, thresholds, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated_grid(first: int, last: int, n: int) -> list[int]:
    """n evenly spaced numbers from first to last, cut to whole ones."""
    return [int(first + i * (last - first) / (n - 1)) for i in range(n)]


#: Budgets, from 100 to 5,000 tokens; the older ten; the edges of their histogram.
BUDGETS = truncated_grid(100, 5000, 20)
OLD_BUDGETS = truncated_grid(100, 2500, 10)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_layer(x: Column, weights: Column, bias: Column, relu: bool) -> Column:
    """weights (one array an output) times x, plus bias, below 0 cut if relu."""
    out = F.zip_with(F.transform(weights, lambda w: dot(w, x)), bias, lambda a, b: a + b)
    return F.transform(out, lambda v: F.greatest(v, F.lit(0.0))) if relu else out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def first_over(p: Column, threshold: float = 0.5) -> Column:
    """The first place (from 0) over the threshold; null if there is none."""
    return F.nullif(F.array_position(F.transform(p, lambda x: x > threshold), F.lit(True)), F.lit(0).cast("bigint")).cast("int") - 1


def most_likely(p: Column) -> Column:
    """The first place (from 0) of the largest value."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def choose_budget(p: Column, bins: list[int], threshold: float = 0.5, too_hard: str = "likeliest") -> Column:
    """STRUCT<budget, too_hard>: the first bin whose probability is over the threshold. If none is: "likeliest" takes
    the most probable bin, "null" none, "last" the last one."""
    at, grid = first_over(p, threshold), F.array(*map(F.lit, bins))
    none = {"likeliest": most_likely(p), "null": F.lit(None).cast("int"), "last": F.lit(len(bins) - 1)}[too_hard]
    return F.struct(F.get(grid, F.coalesce(at, none)).alias("budget"), at.isNull().alias("too_hard"))


def first_correct_class(y: Column) -> Column:
    """The first place (from 0) of a 1; the number of places if there is none."""
    return F.coalesce(F.nullif(F.array_position(y, F.lit(1)), F.lit(0).cast("bigint")).cast("int") - 1, F.size(y))


def one_hot(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == c).cast("int"))


def sigmoid_loss(logit: Column, y: Column, negative: float = 2.5) -> Column:
    """Binary cross entropy of a logit; a label of 0 weighs `negative`."""
    loss = F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))
    return loss * F.when(y > 0, F.lit(1.0)).otherwise(F.lit(negative))


def softmax_loss(logits: Column, label: Column) -> Column:
    """Cross entropy of the class at a place (from 0)."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.log(total) + top - F.get(logits, label)


def stops(actual: Column, target: Column, tolerance: int, ended: Column) -> Column:
    """Whether generation stops: near the target, or at the text's end."""
    return (F.abs(actual - target) <= tolerance) | ended


def unbatched_latency(wall: Column, batch: Column) -> Column:
    """Seconds a request of a batch."""
    return F.try_divide(wall, batch)


def half_precision(v: Column) -> Column:
    """An array of floats after a round trip through 16 bits (11 significant bits; below 2**-14, steps of 2**-24)."""

    def cut(x: Column) -> Column:
        x = x.cast("double")
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(F.abs(x), F.lit(1e-300)))), F.lit(-14)) - 10)
        y = F.rint(x / step) * step
        return F.when(F.abs(y) > 65504, F.signum(x) * F.lit(float("inf"))).otherwise(y).cast("float")

    return F.transform(v, cut)
