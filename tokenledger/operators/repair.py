"""Repairs of tables of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.sources.tables import with_position


def split_ids(df: DataFrame, key: str = "question_id", prompt: str = "prompt", order: str = "row_idx") -> DataFrame:
    """df with an id for each prompt: the first prompt of an id keeps it, each other one gets a number of its own
    above all ids, in order of ids (as texts) and of first rows. Ids are whole numbers as texts."""
    pairs = df.groupBy(key, prompt).agg(F.min(order).alias("_first"))
    ranked = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_first")))
    top = df.agg(F.max(F.col(key).cast("long")).alias("_top"))
    fresh = with_position(ranked.where("_rank > 1").select(F.col(key).alias("_key"), F.col(prompt).alias("_prompt"), "_first"), "_key", "_first", name="_n")
    fresh = fresh.join(F.broadcast(top)).select("_key", "_prompt", (F.col("_top") + F.col("_n") + 1).cast("string").alias("_new"))  # top has one row
    joined = df.join(fresh, (df[key] == F.col("_key")) & (df[prompt] == F.col("_prompt")), "left")
    return joined.withColumn(key, F.coalesce("_new", df[key])).select(df.columns)


def pad_groups(df: DataFrame, size: int = 20, key: str = "question_id", prompt: str = "prompt") -> DataFrame:
    """df with rows added until each prompt has `size`; they hold the id and the prompt alone. Larger groups stay."""
    short = df.groupBy(key, prompt).agg(F.count(F.lit(1)).cast("int").alias("_n")).where(F.col("_n") < size)
    return df.unionByName(short.select(key, prompt, F.explode(F.sequence(F.col("_n") + 1, F.lit(size)))).drop("col"), allowMissingColumns=True)


def replace_verdicts(df: DataFrame, where, verdict, column: str = "is_correct") -> DataFrame:
    """df with a new verdict on some rows."""
    return df.withColumn(column, F.when(where, verdict).otherwise(F.col(column)))
