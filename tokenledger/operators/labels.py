"""Verdicts by question and budget: matrices, collapses, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.text import parse_flag

from .prep import drop_columns_like


def label_matrix(runs: DataFrame, bins: list[int], key: str = "question_id", budget: str = "target_think_tokens", verdict: str = "is_correct", order: str = "row_idx") -> DataFrame:
    """(key, y): for each bin whether the first row of that budget was correct, as 0 or 1; without a row, or without
    a verdict in it, 0. One pass: a conditional minimum a bin instead of a pivot."""
    flag = F.col(verdict) if dict(runs.dtypes)[verdict] == "boolean" else parse_flag(F.col(verdict))
    first = [F.coalesce(F.min_by(flag.cast("int"), F.when(F.col(budget) == b, F.col(order))), F.lit(0)) for b in bins]
    return runs.groupBy(key).agg(F.array(*first).alias("y"))


def first_correct_or_first(runs: DataFrame, key: str = "question_id", verdict: str = "is_correct", order: str = "row_idx") -> DataFrame:
    """Each question's first correct row, else its first row."""
    rest = [c for c in runs.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(~F.coalesce(F.col(verdict), F.lit(False)), F.col(order))).alias("_row")
    return runs.groupBy(key).agg(best).select(*(F.col(f"_row.{c}") if c in rest else F.col(c) for c in runs.columns))


def collapse_steps(runs: DataFrame, key: str = "question_id", step: str = "step_i", verdict: str = "is_correct", drop: tuple[str, ...] = ("problem",)) -> DataFrame:
    """Each question's first step with a verdict, else its last step; an error if its verdicts differ. The step, the
    columns of bins and those to drop go."""
    rest = [c for c in drop_columns_like(runs).columns if c not in (key, step, *drop)]
    row, has = F.struct(*rest), F.col(verdict).isNotNull()
    pick = F.coalesce(F.min_by(row, F.when(has, F.col(step))), F.max_by(row, step))
    one = F.when(F.count_distinct(verdict) <= 1, pick).otherwise(F.raise_error(F.lit("a question has different verdicts")))
    return runs.groupBy(key).agg(one.alias("_row")).select(key, *(F.col(f"_row.{c}") for c in rest))


def minimum_correct(runs: DataFrame, keys: list[str], tokens: str, verdict: str = "is_correct") -> DataFrame:
    """The fewest tokens of a correct row for each key that has one."""
    return runs.where(F.col(verdict)).groupBy(*keys).agg(F.min(tokens).alias("min_tokens"))


def preference_pairs(runs: DataFrame, key: str, text: str, tokens: str, order: str, verdict: str = "is_correct") -> DataFrame:
    """(key, chosen, rejected): the shortest correct and the longest incorrect text of each question that has both;
    empty texts and those with Chinese characters don't count. An extension."""
    usable = runs.where((F.trim(text) != "") & ~F.col(text).rlike(r"[一-鿿]"))
    ok = F.col(verdict)
    both = usable.groupBy(key).agg(F.min_by(text, F.when(ok, F.struct(F.col(tokens), F.col(order)))).alias("chosen"), F.max_by(text, F.when(~ok, F.struct(F.col(tokens), -F.col(order)))).alias("rejected"))
    return both.where("chosen is not null and rejected is not null")


def comparison(static: DataFrame, dynamic: DataFrame, questions: DataFrame, others: DataFrame, recheck_level: int | None = 6, recheck=None) -> DataFrame:
    """Runs of all methods in one table with their levels: static ones, collapsed dynamic ones, and results of other
    methods. recheck(row columns): a verdict that replaces that of one level; verdicts that are missing are false."""
    a = drop_columns_like(static.drop("problem")).withColumn("method", F.lit("static"))
    b = collapse_steps(dynamic).withColumn("method", F.lit("dynamic"))
    runs = a.unionByName(b, allowMissingColumns=True).join(questions, "question_id", "left")
    if recheck is not None:
        runs = runs.withColumn("is_correct", F.when(F.col("level") == recheck_level, recheck).otherwise(F.col("is_correct")))
    return runs.unionByName(others, allowMissingColumns=True).withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))
