"""Trajectories of values over steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_steps(runs: DataFrame, steps: int, key: str, step: str, value: str) -> DataFrame:
    """(key, values): an array with a place for each step, null where there is no row."""
    return runs.groupBy(key).agg(F.array(*(F.max(F.when(F.col(step) == s, F.col(value))) for s in range(steps))).alias("values"))


def trajectories(runs: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """(key, values): the values in order of steps."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).alias("v"))))
    return runs.groupBy(key).agg(F.transform(rows, lambda r: r["v"]).alias("values"))


def step_means(runs: DataFrame, step: str, value: str) -> DataFrame:
    """(step, mean) over trajectories, missing values (null or NaN) left out."""
    return runs.groupBy(step).agg(F.avg(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).alias("mean"))


def autocorrelation(runs: DataFrame, key: str, step: str, value: str, most: int = 20) -> DataFrame:
    """(key, lag, acf) up to lag min(most, steps - 1); null for a trajectory without variance."""
    v = F.transform("values", lambda x: x.cast("double"))
    centred = trajectories(runs, key, step, value).select(key, v.alias("v")).withColumn("mean", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"))
    centred = centred.select(key, F.transform("v", lambda x: x - F.col("mean")).alias("d"))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    centred = centred.select(key, "d", F.size("d").alias("n"), F.nullif(total(F.col("d"), F.col("d")), F.lit(0.0)).alias("whole"))

    def at(lag):
        cross = total(F.slice("d", F.lit(1), F.col("n") - lag), F.slice("d", lag + 1, F.col("n") - lag))
        return F.struct(lag.alias("lag"), F.try_divide(cross, F.col("whole")).alias("acf"))

    # a trajectory stays in its row; only results are exploded
    lags = F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.col("n") - 1)), at)
    return centred.select(key, F.explode(lags).alias("_at")).select(key, "_at.lag", "_at.acf")


def mean_absolute(acf: DataFrame) -> DataFrame:
    """(lag, mean): the mean size of the autocorrelation at each lag."""
    return acf.groupBy("lag").agg(F.avg(F.abs("acf")).alias("mean"))


def periodogram(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density of one full-length segment: mean taken off, Hann window."""
    x = np.asarray(values, float)
    window = np.sin(np.pi * np.arange(len(x)) / len(x)) ** 2
    power = np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 / max(1e-300, (window**2).sum())
    inner = slice(1, -1 if len(x) % 2 == 0 else None)
    power[inner] *= 2
    return np.fft.rfftfreq(len(x)), power


def power_spectrum(runs: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """(key, frequency, power) of each trajectory of two steps or more."""

    def run(batches):
        for batch in batches:
            out = []
            for k, values in zip(batch[key], batch["values"]):
                if len(values) > 1:
                    f, p = periodogram(values)
                    out.append(pd.DataFrame({key: k, "frequency": f, "power": p}))
            yield pd.concat(out) if out else pd.DataFrame({key: [], "frequency": [], "power": []})

    lines = trajectories(runs.where(F.col(value).isNotNull()), key, step, value)
    kind = lines.schema[key].dataType.simpleString()
    return lines.select(key, F.transform("values", lambda x: x.cast("double")).alias("values")).mapInPandas(run, f"{key} {kind}, frequency double, power double")


def numbered_batches(df: DataFrame, size: int, position: str = "row_idx") -> DataFrame:
    """df with batch: the number of each row's batch of positions."""
    return df.withColumn("batch", F.floor(F.col(position) / size))


def stopped(runs: DataFrame, key: str, step: str, actual: str, target: str, ended: str, tolerance: int, max_steps: int) -> DataFrame:
    """(key, stopped_at, reason): where generation, judged step by step in order, stops: at the first step near its target
    ("tolerance") or at the text's end ("end"), else at the last of max_steps steps ("max_steps"); a run of fewer steps that
    meets neither goes on (null, "open"). A step near its target that also ends is an end. Null verdicts are none.

    One fold over each run's ordered steps, which stops counting where it stopped; a step that comes twice is judged twice.
    """
    near = F.coalesce(F.abs(F.col(actual) - F.col(target)) <= tolerance, F.lit(False))
    why = F.when(F.coalesce(F.col(ended), F.lit(False)), "end").when(near, "tolerance")
    rows = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), why.alias("why"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast(runs.schema[step].dataType).alias("at"), F.lit(None).cast("string").alias("why"))

    def judged(state, row):
        n = state["n"] + 1
        reason = F.coalesce(row["why"], F.when(n == max_steps, "max_steps"))
        now = F.struct(n.alias("n"), F.when(reason.isNotNull(), row["s"]).alias("at"), reason.alias("why"))
        return F.when(state["why"].isNotNull(), state).otherwise(now)

    folded = runs.groupBy(key).agg(rows.alias("rows")).select(key, F.aggregate("rows", zero, judged).alias("state"))
    return folded.select(key, F.col("state.at").alias("stopped_at"), F.coalesce("state.why", F.lit("open")).alias("reason"))
