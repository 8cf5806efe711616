"""Queries by name, and the DuckDB SQL that each is held against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenledger.functions import answers as A
from tokenledger.functions import text as X
from tokenledger.functions import vectors as V
from tokenledger.operators import joins, labels, metrics, network, prep, providers, repair, trajectory, validate

from . import views
from .registry import ORACLES, QUERIES, query
from .views import table

__all__ = ["ORACLES", "QUERIES"]

# Scans, projections and filters.


@query("SELECT id, dataset, level FROM problems")
def q_scan_project(spark: SparkSession, d: str) -> DataFrame:
    return views.problems(spark, d).select("id", "dataset", "level")


@query("SELECT row_idx, dataset FROM answers WHERE dataset IN ('aime', 'gsm8k') AND token_count < 600")
def q_isin_filter(spark, d):
    return views.answers(spark, d).where(prep.is_one_of("dataset", ["aime", "gsm8k"]) & (F.col("token_count") < 600)).select("row_idx", "dataset")


@query("SELECT id, coalesce(regexp_matches(level, '(?i)LEVEL [12]'), false) AS hit FROM problems")
def q_pattern_split_complement(spark, d):
    hit, rest = prep.split_by_pattern(views.problems(spark, d), "level", "LEVEL [12]")
    return hit.select("id", F.lit(True).alias("hit")).unionAll(rest.select("id", F.lit(False).alias("hit")))


@query("SELECT id, TRY_CAST(trim(replace(level, 'Level', '')) AS INTEGER) AS level_number, trim(regexp_replace(level, '^Level', '')) AS level_text FROM problems WHERE level IS DISTINCT FROM '?'")
def q_level_cleanup(spark, d):
    p = prep.known_level(views.problems(spark, d))
    return p.select("id", X.level_number(F.col("level")).alias("level_number"), X.level_text(F.col("level")).alias("level_text"))


@query("SELECT id, CAST(NULL AS VARCHAR) AS note, id AS question_id FROM problems WHERE row_idx < (SELECT count(*) // 2 FROM problems)")
def q_first_half_rename(spark, d):
    return prep.first_half(views.problems(spark, d)).select("id", F.lit(None).cast("string").alias("note"), F.col("id").alias("question_id"))


@query("SELECT question_id, is_correct, actual_tokens FROM steps WHERE is_correct IS NULL OR NOT is_correct")
def q_drop_bin_columns(spark, d):
    s = prep.drop_columns_like(views.steps(spark, d))
    return s.where(F.col("is_correct").isNull() | ~F.col("is_correct")).select("question_id", "is_correct", "actual_tokens")


@query("SELECT row_idx, length(generated) > 15 AS hallucinated FROM answers")
def q_long_answers(spark, d):
    return views.answers(spark, d).select("row_idx", X.long_answer(F.col("generated"), 15).alias("hallucinated"))


@query("SELECT row_idx, dataset FROM answers ORDER BY token_count, row_idx LIMIT 25 OFFSET 5")
def q_ordered_head(spark, d):
    return views.answers(spark, d).orderBy("token_count", "row_idx").offset(5).limit(25).select("row_idx", "dataset")


# Sets and joins.


@query("""
SELECT CAST(row_number() OVER (ORDER BY source_rank, row_idx) - 1 AS BIGINT) AS new_id, problem, source_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY problem ORDER BY source_rank, row_idx) AS r FROM (
    SELECT problem, row_idx, 0 AS source_rank FROM (SELECT text AS problem, conv_id * 1000 + turn AS row_idx FROM conversations) UNION ALL SELECT problem, row_idx, 1 FROM problems)) WHERE r = 1
""")
def q_union_dedup_reid(spark, d):
    from tokenledger.sources.tables import with_position

    p = views.problems(spark, d).select("problem", "row_idx")
    turns = table(spark, d, "conversations").select(F.col("text").alias("problem"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"))
    both = prep.union_sources([turns, p])
    first = prep.keep_first(both, ["problem"], "source_rank", "row_idx")
    return with_position(first, "source_rank", "row_idx", name="new_id").select("new_id", "problem", "source_rank")


@query("SELECT count(*) AS n FROM (SELECT lang FROM documents INTERSECT SELECT text FROM documents UNION ALL (SELECT text FROM documents INTERSECT SELECT text FROM conversations) UNION ALL (SELECT source FROM documents INTERSECT SELECT lower(source) FROM documents))")
def q_intersect_count(spark, d):
    t, c = table(spark, d, "documents"), table(spark, d, "conversations")
    shared = prep.shared_texts(t.select("lang"), t.select("text")).unionAll(prep.shared_texts(t.select("text"), c.select("text"))).unionAll(prep.shared_texts(t.select("source"), t.select(F.lower("source"))))
    return shared.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM benchmark e WHERE e.text = c.text) AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = c.text)")
def q_exact_decontam(spark, d):
    # turns that are no evaluation text, neither a benchmark item nor a document
    evaluation = table(spark, d, "benchmark").select("text").unionAll(table(spark, d, "documents").select("text"))
    return prep.drop_exact(table(spark, d, "conversations"), evaluation, "text").select("conv_id", "turn")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents t WHERE contains(t.text, b.text))")
def q_substring_decontam(spark, d):
    # benchmark passages that no document contains
    return prep.drop_contained(table(spark, d, "benchmark").select("item_id", F.col("text").alias("problem")), table(spark, d, "documents")).select("item_id")


@query("""
SELECT id || '-' || dataset AS unique_id, CAST(b AS INTEGER) AS target_think_tokens,
  CASE WHEN dataset = 'aime-250' THEN problem ELSE problem || chr(10) || 'Let''s think step by step and output the final answer within boxed{}.' END || ' Think for ' || b || ' tokens.' AS prompt,
  'Use less than ' || b // 60 || ' sentences.' AS sentences
FROM problems CROSS JOIN (SELECT unnest([""" + ", ".join(map(str, V.BUDGETS)) + """]) AS b)
""")
def q_budget_cross_prompt(spark, d):
    e = prep.expand_budgets(views.problems(spark, d), V.BUDGETS)
    prompt = X.budget_prompt(X.problem_prompt(F.col("problem"), F.col("dataset")), F.col("target_think_tokens"), "token")
    return e.select("unique_id", "target_think_tokens", prompt.alias("prompt"), F.ltrim(X.budget_prompt(F.lit(""), F.col("target_think_tokens"), "sentence")).alias("sentences"))


@query("SELECT p.id, l.t AS target FROM problems p JOIN (SELECT question_id, arg_max(target_think_tokens, row_idx) AS t FROM runs GROUP BY question_id) l ON p.id = l.question_id")
def q_strict_lookup(spark, d):
    r = views.runs(spark, d).select(F.col("question_id").alias("id"), F.col("target_think_tokens").alias("target"), "row_idx")
    p = joins.keep_members(views.problems(spark, d).select("id"), r, "id")
    return joins.strict_lookup(p, r, "id", "target", "row_idx").select("id", "target")


@query("SELECT id, quality, toxic FROM problems LEFT JOIN labels ON id = doc_id")
def q_left_join_m1(spark, d):
    return joins.attach(views.problems(spark, d).select("id"), table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id").select("id", "quality", "toxic")


@query("SELECT question_id, target_think_tokens, max(generated_think_tokens) OVER (PARTITION BY question_id, target_think_tokens) AS last_tokens, row_idx FROM runs")
def q_group_max_attached(spark, d):
    return joins.with_group_max(views.runs(spark, d), ["question_id", "target_think_tokens"], "generated_think_tokens", "last_tokens").select("question_id", "target_think_tokens", "last_tokens", "row_idx")


_PAIRED = "SELECT a.question_id, a.t AS t_r, b.t AS t_o FROM (SELECT question_id, max(target_think_tokens) AS t FROM runs WHERE is_correct GROUP BY 1) a JOIN (SELECT question_id, min(target_think_tokens) AS t FROM runs WHERE is_correct GROUP BY 1) b USING (question_id)"


def _paired(spark, d):
    r = views.runs(spark, d).where("is_correct").groupBy("question_id")
    return joins.paired(r.agg(F.max("target_think_tokens").alias("t")), r.agg(F.min("target_think_tokens").alias("t")), "question_id", ["t"])


@query(_PAIRED)
def q_join_suffixes(spark, d):
    return _paired(spark, d)


@query(f"SELECT avg(CAST(t_r = t_o AS INTEGER)) * 100 AS agreement, avg(t_r - t_o) AS distance FROM ({_PAIRED})")
def q_agreement_distance(spark, d):
    return metrics.agreement(_paired(spark, d), "t_r", "t_o")


@query("SELECT id FROM problems WHERE id NOT IN (SELECT question_id FROM runs)")
def q_missing_keys(spark, d):
    return prep.missing_keys(views.problems(spark, d), views.runs(spark, d).select(F.col("question_id").alias("id")), "id")


@query("SELECT i AS id FROM range((SELECT count(*) FROM labels)) t(i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def q_seq_complete(spark, d):
    return prep.missing_ids(table(spark, d, "labels"), "doc_id").withColumnRenamed("doc_id", "id")


@query("SELECT row_idx FROM runs WHERE row_idx % 4 <> 0")
def q_resume_antijoin(spark, d):
    from tokenledger.sources.tables import pending

    r = views.runs(spark, d).select("row_idx")
    return pending(r, r.where("row_idx % 4 = 0"), "row_idx")


# Aggregates.


@query("SELECT question_id, arg_min(is_correct, row_idx) FILTER (is_correct IS NOT NULL) AS is_correct, arg_min(generated_think_tokens, row_idx) AS tokens FROM runs GROUP BY question_id")
def q_first_nonnull(spark, d):
    r = views.runs(spark, d).select("question_id", "row_idx", "is_correct", F.col("generated_think_tokens").alias("tokens"))
    return prep.first_non_null(r, ["question_id"], "row_idx")


@query("SELECT question_id, row_idx, target_think_tokens, is_correct FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(is_correct, false) DESC, row_idx) AS r FROM runs) WHERE r = 1")
def q_first_correct_row(spark, d):
    return labels.first_correct_or_first(views.runs(spark, d)).select("question_id", "row_idx", "target_think_tokens", "is_correct")


@query("SELECT question_id, is_correct, actual_tokens FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY is_correct IS NULL, CASE WHEN is_correct IS NULL THEN -step_i ELSE step_i END) AS r FROM steps) WHERE r = 1")
def q_dynamic_collapse(spark, d):
    return labels.collapse_steps(views.steps(spark, d))


@query("SELECT question_id, min(generated_think_tokens) AS min_tokens FROM runs WHERE is_correct GROUP BY question_id")
def q_min_tokens_correct(spark, d):
    return labels.minimum_correct(views.runs(spark, d), ["question_id"], "generated_think_tokens")


_EDGES = [100, 366, 633, 900, 1166, 1433, 1700, 1966, 2233, 2500]


@query("SELECT bin, round(count(*) / (SELECT count(*) FROM runs), 9) AS share FROM (SELECT CASE " + " ".join(f"WHEN generated_think_tokens >= {a} AND generated_think_tokens {'<=' if b == 2500 else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END AS bin FROM runs) WHERE bin IS NOT NULL GROUP BY bin")
def q_pct_hist(spark, d):
    h = metrics.percentage_histogram(views.runs(spark, d), "generated_think_tokens", _EDGES)
    return h.select("bin", F.round("share", 9).alias("share"))


@query("""
SELECT CAST(least(floor((x - lx) / (hx - lx) * 30), 29) AS INTEGER) AS bx, CAST(least(floor((y - ly) / (hy - ly) * 30), 29) AS INTEGER) AS "by", count(*) AS n
FROM (SELECT CAST(generated_think_tokens AS DOUBLE) AS x, CAST(target_think_tokens AS DOUBLE) AS y, min(x) OVER () AS lx, max(x) OVER () AS hx, min(y) OVER () AS ly, max(y) OVER () AS hy FROM runs) GROUP BY 1, 2
""")
def q_hist2d(spark, d):
    return metrics.histogram_2d(views.runs(spark, d), "generated_think_tokens", "target_think_tokens", 30)


_Y = ", ".join(f"coalesce(CAST(arg_min(coalesce(CAST(is_correct AS INTEGER), -1), row_idx) FILTER (target_think_tokens = {b}) = 1 AS INTEGER), 0)" for b in V.BUDGETS)
_MATRIX = f"SELECT question_id, [{_Y}] AS y FROM runs GROUP BY question_id"


def _matrix(spark, d):
    return labels.label_matrix(views.runs(spark, d).withColumn("is_correct", F.coalesce("is_correct", F.lit(False))), V.BUDGETS)


@query(_MATRIX)
def q_label_matrix(spark, d):
    return _matrix(spark, d)


@query(f"SELECT question_id, CAST(coalesce(list_position(y, 1) - 1, 20) AS INTEGER) AS class FROM ({_MATRIX})")
def q_first_correct_class(spark, d):
    return _matrix(spark, d).select("question_id", V.first_correct_class(F.col("y")).alias("class"))


@query(f"SELECT question_id, list_transform(range(21), lambda i: CAST(i = coalesce(list_position(y, 1) - 1, 20) AS INTEGER)) AS hot FROM ({_MATRIX})")
def q_onehot(spark, d):
    return _matrix(spark, d).select("question_id", V.one_hot(V.first_correct_class(F.col("y")), 21).alias("hot"))


@query(f"SELECT CAST(i - 1 AS INTEGER) AS bin, round(greatest(avg(y[i]), 1 - avg(y[i])), 9) AS majority, round(1 - avg(y[i]), 9) AS negative FROM ({_MATRIX}), range(1, 21) t(i) GROUP BY i")
def q_baselines(spark, d):
    return metrics.baselines(_matrix(spark, d)).select("bin", F.round("majority", 9).alias("majority"), F.round("negative", 9).alias("negative"))


@query(f"SELECT count(*) AS rows, CAST(20 AS INTEGER) AS columns, round(sum(list_sum(y)) / (count(*) * 20), 9) AS share FROM ({_MATRIX})")
def q_matrix_share(spark, d):
    return metrics.matrix_share(_matrix(spark, d)).withColumn("share", F.round("share", 9))


_EXTRACTED = r"""
SELECT *, CASE k WHEN 0 THEN n WHEN 1 THEN '\frac{' || n || '}{7}' WHEN 2 THEN n WHEN 3 THEN '3' WHEN 4 THEN n WHEN 5 THEN n WHEN 6 THEN n WHEN 7 THEN n WHEN 8 THEN n || ' cm' ELSE generated END AS value
FROM (SELECT *, CASE WHEN generated LIKE 'Thus%' THEN 0 WHEN generated LIKE 'so \boxed%' THEN 1 WHEN generated LIKE '\boxed{1} then%' THEN 2 WHEN generated LIKE '\boxed{3}%' THEN 3 WHEN generated LIKE 'work' || chr(10) || '####%' THEN 4
  WHEN generated LIKE 'work' || chr(10) || ' ####%' THEN 5 WHEN generated LIKE 'so $%' THEN 6 WHEN generated LIKE 'a' || chr(10) || '%' THEN 7 WHEN generated LIKE '\boxed{\text%' THEN 8 ELSE 9 END AS k,
  regexp_extract(CASE WHEN generated LIKE 'so \boxed%' THEN replace(generated, '}{7}', '') ELSE generated END, '([0-9]+)[^0-9]*$', 1) AS n, regexp_extract(solution, '\\boxed\{(.*)\}$', 1) AS wanted FROM answers)
"""
_NORMAL = r"CASE WHEN k = 8 THEN n || ' cm' ELSE value END"
_VERDICT = rf"(SELECT *, replace({_NORMAL}, ' ', '') = replace(wanted, ' ', '') OR coalesce(abs(CASE WHEN k = 1 THEN CAST(n AS DOUBLE) / 7 WHEN k = 9 OR k = 8 THEN NULL ELSE TRY_CAST(value AS DOUBLE) END - CASE WHEN wanted LIKE '%frac%' THEN CAST(regexp_extract(wanted, '([0-9]+)', 1) AS DOUBLE) / 7 ELSE CAST(wanted AS DOUBLE) END) < 1e-9, false) AS ok FROM ({_EXTRACTED}))"


@query(f"""
SELECT dataset, count(*) AS num_total, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS num_correct, round(avg(CAST(ok AS INTEGER)), 9) AS accuracy, round(avg(token_count), 9) AS avg_tokens,
  round(avg(token_count) FILTER (length(value) <= 9), 9) AS avg_tokens_clean, CAST(count(*) FILTER (length(value) > 9) AS BIGINT) AS num_hallucinations FROM {_VERDICT} GROUP BY dataset
""")
def q_model_dataset_summary(spark, d):
    """Texts are scored anew and rolled up for each data set (answers over 9 characters count as hallucinated here)."""
    scored = views.answers(spark, d, dealt=True).withColumn("e", A.evaluate(F.col("solution"), F.col("generated"), "analysis", native=True))
    scored = scored.select("dataset", "token_count", "e.is_correct", X.long_answer(F.col("e.generated_value"), 9).alias("hallucinated"))
    s = metrics.model_dataset_summary(scored, "dataset")
    return s.select("dataset", "num_total", "num_correct", *(F.round(c, 9).alias(c) for c in ("accuracy", "avg_tokens", "avg_tokens_clean")), "num_hallucinations")


@query("SELECT m AS model, " + ", ".join(f"round(avg(token_count) FILTER (dataset = '{x}'), 9) AS avg_tokens__{x.replace('-', '_')}, max(token_count) FILTER (dataset = '{x}') AS top__{x.replace('-', '_')}" for x in views.DATASETS) + " FROM (SELECT *, 'm' || row_idx % 3 AS m FROM answers) GROUP BY m")
def q_report_pivot(spark, d):
    a = views.answers(spark, d).withColumn("model", F.concat(F.lit("m"), F.col("row_idx") % 3)).withColumn("dataset", F.replace("dataset", F.lit("-"), F.lit("_")))
    s = a.groupBy("model", "dataset").agg(F.round(F.avg("token_count"), 9).alias("avg_tokens"), F.max("token_count").alias("top"))
    return metrics.report(s, [x.replace("-", "_") for x in views.DATASETS], ["avg_tokens", "top"])


@query("SELECT level, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM problems GROUP BY level")
def q_value_counts(spark, d):
    return metrics.value_counts(views.problems(spark, d), "level", dropna=False, normalize=True).withColumn("share", F.round("share", 9))


@query("SELECT unnest(['dataset', 'level', 'problem']) AS \"column\", unnest([count(DISTINCT dataset), count(DISTINCT level), count(DISTINCT problem)]) AS n FROM problems")
def q_nunique_cols(spark, d):
    return metrics.unique_counts(views.problems(spark, d), ["dataset", "level", "problem"])


@query("SELECT problem, count(DISTINCT id) AS n FROM problems GROUP BY problem HAVING count(DISTINCT id) > 1")
def q_conflicting_keys(spark, d):
    return validate.conflicting(views.problems(spark, d), "problem", "id")


@query("SELECT CAST(count(*) - count(DISTINCT (question_id, target_think_tokens)) AS BIGINT) AS n FROM runs")
def q_dup_count(spark, d):
    return metrics.duplicate_count(views.runs(spark, d), "question_id", "target_think_tokens")


@query("SELECT question_id, n FROM (SELECT question_id, count(*) AS n, max(count(*)) OVER () AS top FROM runs GROUP BY question_id) WHERE n = top")
def q_largest_groups(spark, d):
    return metrics.largest_groups(views.runs(spark, d), "question_id")


@query("SELECT min(target_think_tokens) AS min, max(target_think_tokens) AS max, round(avg(target_think_tokens), 9) AS mean FROM runs WHERE is_correct")
def q_selected_stats(spark, d):
    return metrics.selected_stats(views.runs(spark, d).where("is_correct"), "target_think_tokens").withColumn("mean", F.round("mean", 9))


@query("SELECT question_id % 5 AS method, target_think_tokens AS level, round(avg(CAST(is_correct AS INTEGER)), 9) AS accuracy, round(avg(generated_think_tokens), 9) AS tokens FROM runs GROUP BY 1, 2")
def q_level_curve(spark, d):
    r = views.runs(spark, d).select((F.col("question_id") % 5).alias("method"), F.col("target_think_tokens").alias("level"), "is_correct", F.col("generated_think_tokens").alias("actual_tokens"))
    return metrics.level_curve(r, "method", "level").select("method", "level", F.round("accuracy", 9).alias("accuracy"), F.round("tokens", 9).alias("tokens"))


_SUMS = "SELECT g, sum(1.0::DOUBLE) s0, sum(x) s1, sum(x*x) s2, sum(x*x*x) s3, sum(x*x*x*x) s4, sum(y) t0, sum(x*y) t1, sum(x*x*y) t2 FROM (SELECT question_id % 5 AS g, CAST(row_idx % 7 AS DOUBLE) AS x, CAST(generated_think_tokens AS DOUBLE) AS y FROM runs) GROUP BY g"


@query(f"""
SELECT g, round((t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0)) / det, 4) AS c2, round((s4*(t1*s0-s1*t0) - t2*(s3*s0-s1*s2) + s2*(s3*t0-t1*s2)) / det, 4) AS c1,
  round((s4*(s2*t0-t1*s1) - s3*(s3*t0-t1*s2) + t2*(s3*s1-s2*s2)) / det, 4) AS c0 FROM (SELECT *, s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2) AS det FROM ({_SUMS}))
""")
def q_polyfit2(spark, d):
    p = views.runs(spark, d).select((F.col("question_id") % 5).alias("g"), (F.col("row_idx") % 7).alias("x"), F.col("generated_think_tokens").alias("y"))
    return metrics.quadratic_fit(p, "x", "y", "g").select("g", *(F.round(c, 4).alias(c) for c in ("c2", "c1", "c0")))


# Text.


@query(r"SELECT row_idx, trim(regexp_extract(generated, '\\boxed\{([^}]*)\}', 1)) AS value FROM answers WHERE regexp_matches(generated, '\\boxed\{([^}]*)\}')")
def q_boxed_simple(spark, d):
    a = views.answers(spark, d).select("row_idx", X.boxed_first(F.col("generated")).alias("value"))
    return a.where("value is not null")


@query(f"SELECT row_idx, CASE WHEN k IN (0, 1, 2, 3, 8) THEN value END AS value FROM ({_EXTRACTED})")
def q_boxed_balanced(spark, d):
    return views.answers(spark, d, dealt=True).select("row_idx", X.boxed_balanced(F.col("generated")).alias("value"))


@query(f"SELECT row_idx, CASE WHEN k IN (0, 1, 2, 3, 8) THEN value END AS value FROM ({_EXTRACTED})")
def q_boxed_balanced_native(spark, d):
    return views.answers(spark, d, dealt=True).select("row_idx", X.boxed_balanced_native(F.col("generated")).alias("value"))


@query(f"SELECT row_idx, CASE WHEN k IN (4, 7) THEN generated ELSE value END AS value FROM ({_EXTRACTED})")
def q_extract_pipeline(spark, d):
    return views.answers(spark, d, dealt=True).select("row_idx", X.extract_answer(F.col("generated"), "pipeline").alias("value"))


@query(f"SELECT row_idx, value FROM ({_EXTRACTED})")
def q_extract_analysis(spark, d):
    return views.answers(spark, d, dealt=True).select("row_idx", X.extract_answer(F.col("generated"), "analysis", native=True).alias("value"))


@query(f"SELECT row_idx, CASE WHEN k = 6 THEN n END AS dollars, CASE WHEN k IN (4, 5) THEN n END AS marked, CASE WHEN k = 7 THEN n END AS number FROM ({_EXTRACTED})")
def q_fallbacks(spark, d):
    g = F.col("generated")
    return views.answers(spark, d).select("row_idx", X.last_dollars(g).alias("dollars"), X.marked_answer(g).alias("marked"), X.lone_number(g).alias("number"))


@query("SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS think, turn % 3 * 50 AS budget, turn % 3 * 50 AS asked FROM conversations WHERE text IS NOT NULL")
def q_think_text(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    n = (F.col("turn") % 3 * 50).cast("string")
    t = F.concat(F.lit("<think>"), "text", F.lit("</think> [["), n, F.lit("]] Think for "), n, F.lit(" tokens."))
    return c.select("conv_id", "turn", X.think_text(t).alias("think"), X.stated_budget(t).alias("budget"), X.prompt_budget(t).alias("asked"))


@query(r"SELECT row_idx, CASE WHEN k = 1 THEN '\frac{' || n || '}{7}' ELSE n END AS form FROM (SELECT *, row_idx % 6 AS k, CAST(1000 + row_idx % 97 AS VARCHAR) AS n FROM answers)")
def q_normalize_steps(spark, d):
    n = (1000 + F.col("row_idx") % 97).cast("string")
    a = views.answers(spark, d, dealt=True).select("row_idx", (F.col("row_idx") % 6).alias("k"), n.alias("n"), F.concat(F.substring(n, 1, 1), F.lit(","), F.substring(n, 2, 3)).alias("t"))
    text = F.when(F.col("k") == 0, F.concat(F.lit("x="), "n")).when(F.col("k") == 1, F.concat(F.lit("\\dfrac{"), "n", F.lit("}7x"))).when(F.col("k") == 2, F.concat("n", F.lit(" \\mbox{ inches}^2"))).when(F.col("k") == 3, F.col("t")).when(F.col("k") == 4, F.concat("n", F.lit("^\\circ "))).otherwise(F.concat(F.lit("\\$"), "n", F.lit("_{8}")))
    return a.select("row_idx", A.normalize_answer(text).alias("form"))


@query("SELECT row_idx, true AS as_set, token_count % 2 = 0 AS as_number, token_count % 2 = 1 AS as_half FROM answers")
def q_set_and_number_equiv(spark, d):
    t, n = F.col("token_count"), F.col("token_count").cast("string")
    return views.answers(spark, d, dealt=True).select(
        "row_idx", A.equivalent(F.concat(F.lit("("), n, F.lit(", -1)")), F.concat(F.lit("[-1,"), n, F.lit("]"))).alias("as_set"),
        A.equivalent(F.concat(F.lit("\\frac{"), n, F.lit("}{2}")), F.floor(t / 2).cast("string")).alias("as_number"),
        A.equivalent(F.concat(F.lit("\\frac{"), n, F.lit("}{2}")), F.concat(F.floor(t / 2).cast("string"), F.lit(".5"))).alias("as_half"))


@query(f"SELECT row_idx, ok AS is_correct, wanted AS expected_value, value AS generated_value FROM {_VERDICT}")
def q_evaluate_answer(spark, d):
    return views.answers(spark, d, dealt=True).select("row_idx", A.evaluate(F.col("solution"), F.col("generated")).alias("e")).select("row_idx", "e.*")


@query(r"""
SELECT row_idx, CASE WHEN k IN (0, 8, 2, 1, 3) THEN CASE k WHEN 0 THEN n WHEN 8 THEN '\text{' || n || ' cm' WHEN 2 THEN '1' WHEN 1 THEN '\frac{' || n ELSE '3' END = CASE WHEN solution LIKE '%frac%' THEN regexp_extract(solution, '\\boxed\{([^}]*)\}', 1) ELSE wanted END ELSE false END AS ok FROM ("""
 + _EXTRACTED + ")")
def q_legacy_equiv(spark, d):
    return views.answers(spark, d, dealt=True).select("row_idx", A.legacy_correct(F.col("solution"), F.col("generated")).alias("ok"))


@query("SELECT part.p_partkey AS id, " + " OR ".join(f"contains(lower(trim(p_name)), '{w}')" for w in X.SECOND_THOUGHTS) + " AS suppressed FROM part")
def q_keyword_suppress(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.has_second_thought(F.col("p_name")).alias("suppressed"))


@query("SELECT doc_id || '-' || lang AS unique_id, lang || '-' || doc_id AS key, 'model_v1_tale' AS run, CASE lower(trim(flag)) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag FROM (SELECT *, [' True ', 'FALSE', 'yes'][doc_id % 3 + 1] AS flag FROM documents)")
def q_keys_and_flags(spark, d):
    flag = F.get(F.array(F.lit(" True "), F.lit("FALSE"), F.lit("yes")), (F.col("doc_id") % 3).cast("int"))
    return table(spark, d, "documents").select(X.pair_key(F.col("doc_id"), F.col("lang")).alias("unique_id"), X.pair_key(F.col("lang"), F.col("doc_id")).alias("key"), X.run_name(F.lit("org/model_v1.bin"), F.lit("tale")).alias("run"), X.parse_flag(flag).alias("flag"))


# Vectors and networks.

_IN, _BINS = 64, 5


def small_network() -> list[tuple]:
    """Weights by a rule of whole numbers, for tests."""
    w = lambda a, b, k: (np.fromfunction(lambda i, j: (i * 7 + j * 13 + k) % 11 - 5, (a, b)) / 8, np.fromfunction(lambda j: (j * 3 + k) % 5 - 2, (b,)) / 4)
    return [w(_IN, 6, 1), w(6, _BINS, 2)]


_MLP = f"""
SELECT vec_id, list_transform(range({_BINS}), lambda o: list_sum(list_transform(range(6), lambda h: hidden[h + 1] * (((h * 7 + o * 13 + 2) % 11 - 5) / 8.0::DOUBLE))) + ((o * 3 + 2) % 5 - 2) / 4.0::DOUBLE) AS z
FROM (SELECT vec_id, list_transform(range(6), lambda h: greatest(0.0::DOUBLE, list_sum(list_transform(range({_IN}), lambda i: CAST(embedding[i + 1] AS DOUBLE) * (((i * 7 + h * 13 + 1) % 11 - 5) / 8.0::DOUBLE))) + ((h * 3 + 1) % 5 - 2) / 4.0::DOUBLE)) AS hidden FROM embeddings)
"""


def _logits(spark, d):
    return network.logits(table(spark, d, "embeddings").select("vec_id", "embedding"), small_network(), "embedding", "z").drop("embedding")


@query(f"SELECT vec_id, list_transform(z, lambda v: round(v, 6)) AS z FROM ({_MLP})")
def q_mlp_forward(spark, d):
    return _logits(spark, d).select("vec_id", F.transform("z", lambda v: F.round(v, 6)).alias("z"))


@query(f"SELECT vec_id, list_transform(z, lambda v: round(v, 6)) AS z FROM ({_MLP})")
def q_mlp_forward_native(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(network.logits_native(F.col("embedding"), small_network()), lambda v: F.round(v, 6)).alias("z"))


def _chosen(threshold, none):
    return f"SELECT vec_id, CAST([100, 357, 615, 873, 1131][coalesce(list_position(list_transform(p, lambda x: x > {threshold}), true), {none})] AS INTEGER) AS budget, list_position(list_transform(p, lambda x: x > {threshold}), true) IS NULL AS too_hard FROM (SELECT vec_id, list_transform(z, lambda v: 1 / (1 + exp(-v))) AS p FROM ({_MLP}))"


def _select(spark, d, threshold, too_hard):
    p = network.probabilities(F.col("z"))
    return _logits(spark, d).select("vec_id", V.choose_budget(p, V.BUDGETS[:_BINS], threshold, too_hard).alias("c")).select("vec_id", "c.*")


@query(_chosen(0.5, "list_position(p, list_max(p))"))
def q_select_bin_05(spark, d):
    return _select(spark, d, 0.5, "likeliest")


@query(_chosen(0.8, "list_position(p, list_max(p))"))
def q_select_bin_08(spark, d):
    return _select(spark, d, 0.8, "likeliest")


@query(_chosen(0.8, _BINS))
def q_too_hard_wrap(spark, d):
    return _select(spark, d, 0.8, "last")


_CELLS = f"(SELECT z[i] AS z, CAST((vec_id + i - 1) % 3 = 0 AS INTEGER) AS y FROM ({_MLP}), range(1, {_BINS + 1}) t(i))"


@query(f"SELECT round(avg((greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) * CASE WHEN y = 1 THEN 1 ELSE 2.5 END), 6) AS loss, round(avg(CAST((1 / (1 + exp(-z)) > 0.5) = (y = 1) AS INTEGER)), 9) AS accuracy, round(avg(CAST(1 / (1 + exp(-z)) <= 0.5 AS INTEGER)) FILTER (y = 0), 9) AS tnr FROM {_CELLS}")
def q_bce_tnr(spark, d):
    y = F.transform(F.sequence(F.lit(0), F.lit(_BINS - 1)), lambda i: ((F.col("vec_id") + i) % 3 == 0).cast("int"))
    m = metrics.binary_metrics(_logits(spark, d).withColumn("y", y), "z", "y")
    return m.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 9).alias("accuracy"), F.round("tnr", 9).alias("tnr"))


@query(f"SELECT round(avg(ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[label % {_BINS} + 1]), 6) AS loss FROM ({_MLP}) JOIN embeddings USING (vec_id)")
def q_softmax_loss(spark, d):
    e = network.logits(table(spark, d, "embeddings"), small_network(), "embedding", "z")
    return e.agg(F.round(F.avg(V.softmax_loss(F.col("z"), F.col("label") % _BINS)), 6).alias("loss"))


@query(f"SELECT CAST(c AS INTEGER) AS class, CAST(count(label) AS BIGINT) AS n, round(coalesce(avg(CAST(b = label AS INTEGER)), 1.0), 9) AS accuracy FROM range(12) t(c) LEFT JOIN (SELECT label, list_position(z, list_max(z)) - 1 AS b FROM ({_MLP}) JOIN embeddings USING (vec_id)) ON label = c GROUP BY c")
def q_class_metrics(spark, d):
    e = network.logits(table(spark, d, "embeddings"), small_network(), "embedding", "z").select("label", V.most_likely(F.col("z")).alias("b"))
    return metrics.class_metrics(e, "b", "label", 12).withColumn("accuracy", F.round("accuracy", 9))


# Trajectories and repairs.

_TRAJECTORY = "(SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY row_idx) - 1 AS s, CAST(generated_think_tokens AS DOUBLE) AS v FROM runs)"


def _numbered(spark, d):
    s = F.row_number().over(Window.partitionBy("question_id").orderBy("row_idx")) - 1
    return views.runs(spark, d).select("question_id", s.alias("s"), F.col("generated_think_tokens").cast("double").alias("v"))


@query(f"SELECT question_id, list_transform(range((SELECT max(s) + 1 FROM {_TRAJECTORY})), lambda i: vs[CAST(i + 1 AS INTEGER)]) AS values FROM (SELECT question_id, list(v ORDER BY s) AS vs FROM {_TRAJECTORY} GROUP BY question_id)")
def q_traj_pivot(spark, d):
    numbered = _numbered(spark, d)
    steps = numbered.agg(F.max("s")).first()[0]
    return trajectory.pivot_steps(numbered, (steps + 1) if steps is not None else 0, "question_id", "s", "v")


@query(f"SELECT question_id, list(v ORDER BY s) AS values FROM {_TRAJECTORY} GROUP BY question_id")
def q_traj_whole(spark, d):
    """Trajectories as long as they are."""
    return trajectory.trajectories(_numbered(spark, d), "question_id", "s", "v")


@query(f"""
SELECT question_id, CAST(lag AS INTEGER) AS lag, round(c / nullif(t, 0), 6) AS acf FROM (
  SELECT a.question_id, a.s - b.s AS lag, sum(a.d * b.d) AS c, any_value(a.t) AS t FROM (SELECT *, sum(d * d) OVER (PARTITION BY question_id) AS t FROM (SELECT *, v - avg(v) OVER (PARTITION BY question_id) AS d FROM {_TRAJECTORY})) a
  JOIN (SELECT *, v - avg(v) OVER (PARTITION BY question_id) AS d FROM {_TRAJECTORY}) b ON a.question_id = b.question_id AND a.s - b.s BETWEEN 0 AND 20 GROUP BY 1, 2)
""")
def q_acf(spark, d):
    return trajectory.autocorrelation(_numbered(spark, d), "question_id", "s", "v").withColumn("acf", F.round("acf", 6))


@query(f"SELECT CAST(s AS INTEGER) AS s, round(avg(v), 6) AS mean FROM {_TRAJECTORY} GROUP BY s")
def q_nanmean_step(spark, d):
    return trajectory.step_means(_numbered(spark, d), "s", "v").withColumn("mean", F.round("mean", 6))


@query(f"""
SELECT question_id, round(k / n, 9) AS frequency, round((re * re + im * im) / w2 * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END, 2) + 0.0 AS power FROM (
  SELECT question_id, n, k, sum(x * cos(2 * pi() * k * s / n)) AS re, sum(x * sin(2 * pi() * k * s / n)) AS im, any_value(w2) AS w2 FROM (
    SELECT *, (v - avg(v) OVER p) * pow(sin(pi() * s / n), 2) AS x, sum(pow(sin(pi() * s / n), 4)) OVER p AS w2 FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM {_TRAJECTORY} WHERE v IS NOT NULL) WINDOW p AS (PARTITION BY question_id)),
    unnest(range(n // 2 + 1)) AS t(k) WHERE n > 1 GROUP BY question_id, n, k)
""")
def q_welch_psd(spark, d):
    return trajectory.power_spectrum(_numbered(spark, d), "question_id", "s", "v").select("question_id", F.round("frequency", 9).alias("frequency"), (F.round("power", 2) + 0.0).alias("power"))


@query("""
SELECT row_idx, CASE WHEN r = 1 THEN q ELSE CAST((SELECT max(question_id) FROM runs) + n AS VARCHAR) END AS question_id FROM (SELECT *, CAST(question_id AS VARCHAR) AS q, target_think_tokens AS prompt FROM runs)
JOIN (SELECT q, prompt, r, sum(CAST(r > 1 AS INTEGER)) OVER (ORDER BY q, f) AS n FROM (SELECT q, prompt, f, row_number() OVER (PARTITION BY q ORDER BY f) AS r FROM (SELECT CAST(question_id AS VARCHAR) AS q, target_think_tokens AS prompt, min(row_idx) AS f FROM runs GROUP BY 1, 2))) USING (q, prompt)
""")
def q_repair_ids(spark, d):
    r = views.runs(spark, d).select("row_idx", F.col("question_id").cast("string").alias("question_id"), F.col("target_think_tokens").cast("string").alias("prompt"))
    return repair.split_ids(r).select("row_idx", "question_id")


@query("SELECT question_id, 'p' AS prompt, row_idx FROM runs UNION ALL SELECT question_id, 'p', NULL FROM (SELECT question_id, unnest(range(20 - n)) FROM (SELECT question_id, count(*) AS n FROM runs GROUP BY 1) WHERE n < 20)")
def q_pad_to_20(spark, d):
    r = views.runs(spark, d).select("question_id", F.lit("p").alias("prompt"), "row_idx")
    return repair.pad_groups(r, 20)


@query("SELECT question_id, CASE WHEN target_think_tokens = 100 THEN generated_think_tokens > 300 ELSE is_correct END AS is_correct, row_idx FROM runs")
def q_replace_verdicts(spark, d):
    r = repair.replace_verdicts(views.runs(spark, d), F.col("target_think_tokens") == 100, F.col("generated_think_tokens") > 300)
    return r.select("question_id", "is_correct", "row_idx")


@query("""
SELECT question_id, method, CAST(question_id % 7 AS INTEGER) AS level, CASE WHEN question_id % 7 = 6 AND method <> 'other' THEN actual_tokens % 2 = 0 ELSE coalesce(is_correct, false) END AS is_correct, actual_tokens FROM (
  SELECT question_id, 'static' AS method, is_correct, generated_think_tokens AS actual_tokens FROM runs
  UNION ALL SELECT question_id, 'dynamic', is_correct, actual_tokens FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY is_correct IS NULL, CASE WHEN is_correct IS NULL THEN -step_i ELSE step_i END) AS r FROM steps) WHERE r = 1
  UNION ALL SELECT question_id, 'other', is_correct, generated_think_tokens FROM runs)
""")
def q_method_comparison(spark, d):
    r = views.runs(spark, d)
    static = r.select("question_id", F.lit("p").alias("problem"), "is_correct", F.col("generated_think_tokens").alias("actual_tokens"))
    questions = r.select("question_id").distinct().withColumn("level", (F.col("question_id") % 7).cast("int"))
    others = r.select("question_id", (F.col("question_id") % 7).cast("int").alias("level"), "is_correct", F.col("generated_think_tokens").alias("actual_tokens"), F.lit("other").alias("method"))
    c = labels.comparison(static, views.steps(spark, d), questions, others, 6, F.col("actual_tokens") % 2 == 0)
    return c.select("question_id", "method", "level", "is_correct", "actual_tokens")


@query("SELECT question_id, arg_min(CAST(row_idx AS VARCHAR), (generated_think_tokens, row_idx)) FILTER (is_correct) AS chosen, arg_max(CAST(row_idx AS VARCHAR), (generated_think_tokens, -row_idx)) FILTER (NOT is_correct) AS rejected FROM runs GROUP BY 1 HAVING chosen IS NOT NULL AND rejected IS NOT NULL")
def q_preference_pairs(spark, d):
    r = views.runs(spark, d).withColumn("text", F.col("row_idx").cast("string"))
    return labels.preference_pairs(r, "question_id", "text", "generated_think_tokens", "row_idx")


@query(r"""
SELECT id, CAST(CAST('0x' || left(sha256(p), 6) AS INTEGER) % 100 AS VARCHAR) AS value,
  CAST(len(regexp_extract_all('<think>' || left(p, 20) || '</think> .', '[^ \t\n\x0B\f\r]+')) AS INTEGER) AS tokens FROM (SELECT id, coalesce(problem, '') AS p FROM problems)
""")
def q_provider_stub(spark, d):
    p = views.problems(spark, d).select("id", F.col("problem").alias("prompt"))
    g = providers.generated(p, lambda: providers.stub_generate)
    return g.select("id", X.extract_answer(F.col("generated")).alias("value"), providers.stub_token_count(F.col("generated")).alias("tokens"))


@query("SELECT region.r_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def q_harness_star_join(spark, d):
    """Coverage of the test tables, no feature of its own."""
    li, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
