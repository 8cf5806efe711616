"""Logical tables made from the test tables, by the same whole-number expressions here and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.vectors import BUDGETS
from tokenledger.operators.prep import spread

DATASETS = ("gsm8k", "math-500", "aime", "aime-250", "olympiad")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def answers(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """Generated texts of every shape an answer comes in, and solutions. dealt: spread over all cores, for work that
    takes long a row."""
    rows = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) if dealt else table(spark, folder, "lineitem")
    rows = rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_idx"), (F.col("l_orderkey") % 5).alias("d"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).alias("k"),
        (F.col("l_partkey") % 100).cast("string").alias("n"), (F.col("l_partkey") % 100 + 1).cast("string").alias("m"), (F.col("l_linenumber") % 3).alias("s"),
        (F.col("l_suppkey") % 997 + F.col("l_linenumber") * 100).alias("token_count"))
    n = F.col("n")
    shapes = [("Thus \\boxed{", "}"), ("so \\boxed{\\frac{", "}{7}} ok"), ("\\boxed{1} then \\boxed{", "}"), ("\\boxed{3} and \\boxed{\\frac{1}{", ""), ("work\n#### ", ""), ("work\n #### ", " "), ("so $x+1$ and $", "$"), ("a\n", ""), ("\\boxed{\\text{", " cm}}"), ("no answer ", "")]
    text = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    made = F.lit(None).cast("string")
    for k, (a, b) in enumerate(shapes):
        made = F.when(F.col("k") == k, text(a, n, b)).otherwise(made)
    solution = F.when(F.col("s") == 0, text("\\boxed{", n, "}")).when(F.col("s") == 1, text("\\boxed{", F.col("m"), "}")).otherwise(text("\\boxed{\\frac{", n, "}{7}}"))
    return rows.select("row_idx", F.get(F.array(*map(F.lit, DATASETS)), F.col("d").cast("int")).alias("dataset"), solution.alias("solution"), made.alias("generated"), "token_count")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of questions with budgets; some have no verdict."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("row_idx"), F.col("user_id").alias("question_id"), F.get(F.array(*map(F.lit, BUDGETS)), (F.col("event_id") % 20).cast("int")).alias("target_think_tokens"),
        F.when(kind == "error", F.lit(None).cast("boolean")).otherwise(kind.isin("purchase", "signup")).alias("is_correct"), F.floor(F.col("value") * 10).cast("long").alias("generated_think_tokens"))


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """runs in steps, with one verdict at most for a question, and a column of bins."""
    r = runs(spark, folder)
    verdict = F.when(F.col("row_idx") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("question_id") % 2 == 0)
    return r.select(F.col("question_id"), F.col("row_idx").alias("step_i"), F.lit("p").alias("problem"), verdict.alias("is_correct"), F.col("generated_think_tokens").alias("actual_tokens"), F.lit(0.5).alias("bin_100"))


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as problems; levels are missing, unknown or numbers."""
    level = F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 7 == 6, F.lit("?")).otherwise(F.concat(F.lit("Level "), (F.col("doc_id") % 7).cast("string")))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("row_idx"), F.col("doc_id").alias("id"), F.col("source").alias("dataset"), F.col("text").alias("problem"), F.col("lang").alias("solution"), level.alias("level"))


_GRID = ", ".join(map(str, BUDGETS))
_NAMES = ", ".join(f"'{d}'" for d in DATASETS)

#: The same tables in DuckDB's SQL.
SQL = rf"""
answers AS (SELECT l_orderkey * 8 + l_linenumber AS row_idx, [{_NAMES}][l_orderkey % 5 + 1] AS dataset,
  CASE l_linenumber % 3 WHEN 0 THEN '\boxed{{' || n || '}}' WHEN 1 THEN '\boxed{{' || m || '}}' ELSE '\boxed{{\frac{{' || n || '}}{{7}}}}' END AS solution,
  CASE (l_orderkey + l_linenumber) % 10 WHEN 0 THEN 'Thus \boxed{{' || n || '}}' WHEN 1 THEN 'so \boxed{{\frac{{' || n || '}}{{7}}}} ok' WHEN 2 THEN '\boxed{{1}} then \boxed{{' || n || '}}'
    WHEN 3 THEN '\boxed{{3}} and \boxed{{\frac{{1}}{{' || n WHEN 4 THEN 'work' || chr(10) || '#### ' || n WHEN 5 THEN 'work' || chr(10) || ' #### ' || n || ' '
    WHEN 6 THEN 'so $x+1$ and $' || n || '$' WHEN 7 THEN 'a' || chr(10) || n WHEN 8 THEN '\boxed{{\text{{' || n || ' cm}}}}' ELSE 'no answer ' || n END AS generated,
  l_suppkey % 997 + l_linenumber * 100 AS token_count
  FROM (SELECT *, CAST(l_partkey % 100 AS VARCHAR) AS n, CAST(l_partkey % 100 + 1 AS VARCHAR) AS m FROM lineitem)),
runs AS (SELECT event_id AS row_idx, user_id AS question_id, CAST([{_GRID}][event_id % 20 + 1] AS INTEGER) AS target_think_tokens,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type IN ('purchase', 'signup') END AS is_correct, CAST(floor(value * 10) AS BIGINT) AS generated_think_tokens FROM events),
steps AS (SELECT question_id, row_idx AS step_i, 'p' AS problem, CASE WHEN row_idx % 3 = 0 THEN NULL ELSE question_id % 2 = 0 END AS is_correct, generated_think_tokens AS actual_tokens, 0.5 AS bin_100 FROM runs),
problems AS (SELECT doc_id AS row_idx, doc_id AS id, source AS dataset, text AS problem, lang AS solution,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 6 THEN '?' ELSE 'Level ' || CAST(doc_id % 7 AS VARCHAR) END AS level FROM documents)
"""
