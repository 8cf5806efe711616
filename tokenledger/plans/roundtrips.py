"""Queries of readers, writers, small text and vector functions, and checks, each with the SQL it is held against.

What is written goes to the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.functions import answers as A
from tokenledger.functions import sql
from tokenledger.functions import text as X
from tokenledger.functions import vectors as V
from tokenledger.functions.symbolic import symbolic_equal
from tokenledger.operators import joins, metrics, network, prep, providers, trajectory, validate
from tokenledger.sources import npy, tables

from . import lifecycle, views
from .catalog import _BINS, _MATRIX, _MLP, small_network
from .registry import query
from .views import table


def _folder(spark: SparkSession) -> str:
    prep.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


# Readers and writers.


@query("SELECT doc_id, text, lang FROM documents")
def q_read_batches(spark: SparkSession, d: str) -> DataFrame:
    docs, at = table(spark, d, "documents").select("doc_id", "text", "lang"), _folder(spark)
    docs.repartition(3).write.parquet(at)
    # a folder that is not there is an empty table
    return tables.read_batches(spark, at, docs.schema).unionByName(tables.read_batches(spark, f"{at}-none", docs.schema))


@query("SELECT c_custkey, c_name, n_name || ', \"' || c_mktsegment || chr(34) || chr(10) || 'x' AS note FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_read_csv(spark, d):
    at = _folder(spark)
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", "c_name", F.concat("n_name", F.lit(', "'), "c_mktsegment", F.lit('"\nx')).alias("note"))
    c.repartition(2).write.option("header", True).option("escape", '"').csv(at)
    return tables.read_csv(spark, at, c.schema)


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def q_read_csv_headerless(spark, d):
    at = _folder(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").write.csv(at)
    return tables.read_csv(spark, at, T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType())]), header=False).select(F.col("key"), "name")


@query("SELECT doc_id, text, lang FROM documents")
def q_read_json_lines(spark, d):
    docs, at = table(spark, d, "documents").select("doc_id", "text", "lang"), _folder(spark)
    docs.write.json(at)
    return tables.read_json_lines(spark, at, docs.schema)


@query("SELECT item_id, text FROM benchmark")
def q_load_split(spark, d):
    at = _folder(spark)
    table(spark, d, "benchmark").select("item_id", "text").write.parquet(f"{at}/bench/main/test.parquet")
    return lifecycle.load_split(spark, at, "bench", config="main")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_idx, embedding AS vector FROM embeddings")
def q_npy(spark, d):
    at = f"{_folder(spark)}/vectors.npy"
    npy.write_npy(table(spark, d, "embeddings"), at, "embedding", "vec_id")
    return npy.read_npy(spark, at).select("row_idx", "vector")


@query("SELECT CAST(question_id AS VARCHAR) AS id, CAST(max(target_think_tokens) AS INTEGER) AS target FROM runs GROUP BY question_id")
def q_keyed_targets(spark, d):
    at = _folder(spark)
    targets = views.runs(spark, d).groupBy(F.col("question_id").cast("string").alias("id")).agg(F.max("target_think_tokens").cast("int").alias("target"))
    tables.write_parquet(targets, at)
    return joins.strict_lookup(targets.select("id"), tables.read_parquet(spark, at, ["id", "target"]).withColumn("at", F.lit(0)), "id", "target", "at").select("id", "target")


@query(f"SELECT vec_id, list_transform(z, lambda v: round(v, 6)) AS z FROM ({_MLP})")
def q_saved_network(spark, d):
    at = _folder(spark)
    tables.save_network(spark, small_network(), at, bins=_BINS)
    layers, about = tables.load_network(spark, at)
    assert about == {"bins": _BINS}
    z = network.logits(table(spark, d, "embeddings"), [(np.array(w), np.array(b)) for w, b in layers], "embedding", "z")
    return z.select("vec_id", F.transform("z", lambda v: F.round(v, 6)).alias("z"))


@query("SELECT n_name, 'a' AS name FROM nation UNION ALL SELECT r_name, 'c' FROM region")
def q_read_existing(spark, d):
    at = _folder(spark)
    tables.write_parquet(table(spark, d, "nation").select("n_name"), f"{at}/a")
    tables.write_parquet(table(spark, d, "region").select(F.col("r_name").alias("n_name")), f"{at}/c")
    return tables.read_existing(spark, {x: f"{at}/{x}" for x in "abc"})


@query("SELECT text AS problem FROM benchmark UNION ALL SELECT problem FROM problems")
def q_problem_column(spark, d):
    raw = table(spark, d, "benchmark").withColumnRenamed("text", "Question"), views.problems(spark, d)
    return raw[0].select(F.col(tables.problem_column(raw[0])).alias("problem")).unionAll(raw[1].select(tables.problem_column(raw[1])))


@query("SELECT name, CAST(n AS INTEGER) AS n, CAST(count(row_idx) AS BIGINT) AS answers FROM (VALUES ('aime', 1), ('gsm8k', 2), ('none', 3)) t(name, n) LEFT JOIN answers ON dataset = name GROUP BY 1, 2")
def q_inline(spark, d):
    small = tables.inline(spark, [("aime", 1), ("gsm8k", 2), ("none", 3)], "name string, n int")
    a = views.answers(spark, d)
    return small.join(a, F.col("dataset") == F.col("name"), "left").groupBy("name", "n").agg(F.count("row_idx").alias("answers"))


@query("SELECT run_name, dataset, count(*) AS n, sum(token_count) AS tokens FROM answers, (VALUES ('m_token'), ('m_tale')) t(run_name) GROUP BY 1, 2")
def q_write_runs(spark, d):
    at = _folder(spark)
    for run in ("m_token", "m_tale"):
        tables.write_runs(views.answers(spark, d), at, run)
    return tables.read_parquet(spark, at).groupBy("run_name", "dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"))


@query("SELECT id, dataset FROM problems")
def q_run_resumable(spark, d):
    at, work = _folder(spark), views.problems(spark, d).select("id", "dataset")
    tables.write_parquet(views.problems(spark, d).where("level is null").select("id", "dataset"), at)  # what an earlier run left
    return tables.run_resumable(work, lambda rows: rows, at, "id", batches=3)


# Checks and small aggregates.


@query("SELECT round(avg(CAST(is_correct AS INTEGER)) * 100, 9) AS accuracy, round(avg(generated_think_tokens), 9) AS avg_tokens FROM runs")
def q_metric_line(spark, d):
    m = metrics.accuracy_and_tokens(views.runs(spark, d), tokens="generated_think_tokens")
    return m.select(F.round("accuracy", 9).alias("accuracy"), F.round("avg_tokens", 9).alias("avg_tokens"))


@query(r"SELECT row_idx FROM answers WHERE NOT regexp_matches(generated, '\\boxed\{[^}]*\}')")
def q_without_answer(spark, d):
    return validate.without_answer(views.answers(spark, d), "generated").select("row_idx")


@query("SELECT count(*) AS n_rows, CAST(5 AS INTEGER) AS n_columns FROM answers")
def q_shape(spark, d):
    return validate.shape(views.answers(spark, d))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_idx, vec_id, label FROM embeddings")
def q_by_position(spark, d):
    e = table(spark, d, "embeddings")
    a, b = (tables.with_position(e.select("vec_id", *more), "vec_id") for more in ((), ("label",)))
    return joins.by_position(a, b.drop("vec_id")).select("row_idx", "vec_id", "label")


@query(f"SELECT question_id, hidden, y FROM ({_MATRIX}) JOIN (SELECT question_id, [CAST(min(row_idx) AS FLOAT)] AS hidden FROM runs GROUP BY 1) USING (question_id)")
def q_training_matrix(spark, d):
    r = views.runs(spark, d).withColumn("is_correct", F.coalesce("is_correct", F.lit(False))).withColumn("hidden", F.array(F.col("row_idx").cast("float")))
    return lifecycle.training_matrix(r).select("question_id", "hidden", "y")


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n, count(*) OVER (PARTITION BY text) AS sharing FROM documents")
def q_once_per_text(spark, d):
    """Documents with their text's length, and how many of them share the call that gave it."""
    stage = lambda texts: texts.select("text", F.char_length("text").alias("n"), F.monotonically_increasing_id().alias("call"))
    found = joins.once_per_text(table(spark, d, "documents").select("doc_id", "text"), "text", stage)
    return found.select("doc_id", "n", F.count(F.lit(1)).over(Window.partitionBy("call")).alias("sharing"))


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n, CASE WHEN text IS NULL THEN NULL WHEN text IN (SELECT text FROM documents WHERE lang = 'en') THEN 1 ELSE 2 END AS made_in FROM documents")
def q_cached_per_text(spark, d):
    """Documents through a stage whose results are kept: a run over those in English, then one over all, which finds the first one's."""
    docs, at, table_name = table(spark, d, "documents").select("doc_id", "text", "lang"), _folder(spark), f"cache_{uuid.uuid4().hex}"
    stage = lambda run: lambda texts: texts.select("text", F.char_length("text").alias("n"), F.lit(run).alias("made_in"))
    joins.cached_per_text(docs.where("lang = 'en'"), "text", stage(1), table_name, at, buckets=8)
    return joins.cached_per_text(docs, "text", stage(2), table_name, at, buckets=8).select("doc_id", "n", "made_in")


@query("SELECT DISTINCT lang FROM documents")
def q_unique_values(spark, d):
    return metrics.unique_values(table(spark, d, "documents"), "lang")


@query("SELECT round(avg(t), 6) AS tokens FROM (SELECT avg(generated_think_tokens) AS t FROM runs GROUP BY row_idx // 512)")
def q_batch_means(spark, d):
    return metrics.batch_means(views.runs(spark, d).withColumnRenamed("generated_think_tokens", "tokens"), 512, "tokens").select(F.round("tokens", 6).alias("tokens"))


@query("SELECT row_idx // 100 AS batch, count(*) AS n FROM runs GROUP BY 1")
def q_numbered_batches(spark, d):
    return trajectory.numbered_batches(views.runs(spark, d), 100).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT question_id, target_think_tokens, count(*) AS count FROM runs GROUP BY 1, 2 HAVING count(*) > 1")
def q_duplicate_keys(spark, d):
    r = validate.require_columns(views.runs(spark, d), "question_id", "target_think_tokens")
    validate.require_same_count(r, r.select("row_idx"))
    validate.require_none(validate.duplicate_keys(r, "row_idx"), "a row twice")
    return validate.duplicate_keys(r, "question_id", "target_think_tokens")


@query("SELECT id, true AS once, true AS as_the_rule, true AS near_share FROM problems")
def q_hash_split(spark, d):
    """Each problem is in exactly one part, in that its hash says, and reruns agree; the part held out is near its share."""
    p = views.problems(spark, d).select("id")
    (held, rest), (again, _) = prep.hash_split(p, "id", 0.2), prep.hash_split(p, "id", 0.2)
    parts = held.withColumn("held", F.lit(1)).unionAll(rest.withColumn("held", F.lit(0))).unionAll(again.withColumn("held", F.lit(2)))
    places = parts.groupBy("id").agg(F.array_sort(F.collect_list("held")).alias("parts"))
    rule = F.when(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(1_000_000)) < 200_000, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    share = held.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(p.agg(F.count(F.lit(1)).alias("total"))))  # a row beside a row
    near = share.select((F.abs(F.col("n") / F.col("total") - 0.2) < 0.05).alias("near_share"))
    checked = p.join(places, "id", "left").join(F.broadcast(near))
    return prep.shuffled(checked, "id", 3).select("id", (F.size("parts") < 3).alias("once"), (F.col("parts") == rule).alias("as_the_rule"), "near_share")


# Text.


_TASK = X.ESTIMATE_TASK.replace("'", "''")


@query(rf"""
SELECT conv_id, turn, coalesce(text, '') AS span, '7' AS part, 'Q: ' || text || '{_TASK}' AS bare, replace('aimee' || turn, 'aimee', '6') AS mapped, text || chr(10) || 'b' AS solution, 'user: ' || text || ' /end' AS chat
FROM conversations WHERE text IS NOT NULL AND NOT contains(text, '</think>')
""")
def q_text_parts(spark, d):
    c, t = table(spark, d, "conversations").where("text is not null and not contains(text, '</think>')"), F.col("text")
    return c.select(
        "conv_id", "turn", X.think_span(F.concat(F.lit("a<think>"), t, F.lit("</think>"))).alias("span"), X.id_part(F.concat("conv_id", F.lit("-7-x"))).alias("part"),
        X.estimate_prompt(F.concat(t, F.lit("#tail")), "#tail").alias("bare"), X.remap(F.concat(F.lit("aimee"), "turn"), {"aimee": "6"}).alias("mapped"),
        X.solution_text(F.array(t, F.lit("b")), "array<string>").alias("solution"), X.chat_prompt(t, "user: {} /end").alias("chat"))


@query(r"""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN repeat('{', k) || p_partkey || repeat('}', k) WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE repeat('x', 3000) || p_partkey END AS value,
  '\frac' || CASE WHEN p_partkey % 3 = 2 THEN '{' || repeat('x', 4000) || '}{2}' ELSE '{' || repeat('{', k) || '1' || repeat('}', k) || '}{' || left(CAST(p_partkey AS VARCHAR), 1) || '}' END AS fraction
FROM (SELECT *, p_partkey % 60 AS k FROM part)
""")
def q_answers_of_any_depth(spark, d):
    k, n = (F.col("p_partkey") % 60).cast("int"), F.col("p_partkey").cast("string")
    deep = F.concat(F.lit("so \\boxed{"), F.repeat(F.lit("{"), k), n, F.repeat(F.lit("}"), k), F.lit("} ok"))
    inner = F.concat(F.lit("\\boxed{\\boxed{"), n, F.lit("}} then \\boxed{{"), n, F.lit("}"))
    text = F.when(F.col("p_partkey") % 3 == 0, deep).when(F.col("p_partkey") % 3 == 1, inner).otherwise(F.concat(F.lit("\\boxed{"), F.lit("x" * 3000), n, F.lit("}")))
    fraction = F.when(F.col("p_partkey") % 3 == 2, F.lit("\\frac{" + "x" * 4000 + "}2 tail")).otherwise(F.concat(F.lit("\\dfrac{"), F.repeat(F.lit("{"), k), F.lit("1"), F.repeat(F.lit("}"), k), F.lit("}"), n))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.boxed_balanced_native(text).alias("value"), A.normalize_answer(fraction).alias("fraction"))


@query(r"""
SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN n WHEN 1 THEN '\sqrt{' || right(n, 1) || '}' WHEN 2 THEN n WHEN 3 THEN '\frac{1}{2}' WHEN 4 THEN '\frac{' || n || '}{7}' WHEN 6 THEN n
  WHEN 7 THEN '\sqrt{0.' || n || '}' WHEN 8 THEN '\frac{' || left(n, 1) || '}{3}' || n WHEN 9 THEN 'abc=' || n END AS form FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS n FROM part)
""")
def q_legacy_forms(spark, d):
    n = F.col("p_partkey").cast("string")
    shapes = [
        F.concat(F.lit("k = "), n, F.lit("^\\circ")), F.concat(F.lit("\\sqrt"), F.substring(n, -1, 1)), F.concat(n, F.lit("\\text{ cm}")), F.lit(".5"), F.concat(n, F.lit("/7")),
        F.concat(n, F.lit("\\text{ a}\\text{ b}")), F.concat(F.lit("\\$"), n, F.lit("\\%\n")), F.concat(F.lit("\\sqrt{."), n, F.lit("}")),
        F.concat(F.lit("\\tfrac"), F.substring(n, 1, 1), F.lit("3\\!"), n), F.concat(F.lit("abc="), n),
    ]
    made = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        made = F.when(F.col("p_partkey") % 10 == k, shape).otherwise(made)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), A.legacy_form(made).alias("form"))


@query("""
SELECT p_partkey AS id, p_partkey % 3 > 0 AS same, p_partkey % 2 = 0 AS square, p_partkey % 4 = 1 AS moved, p_partkey % 5 > 0 OR p_partkey = 1 AS power,
  p_partkey % 2 = 0 OR p_partkey = 1 AS sine, p_partkey % 7 > 0 AS root FROM part
""")
def q_symbolic_equiv(spark, d):
    """Pairs of expressions, some of which are the same: quotients, products, powers of any degree, functions and roots."""
    n, key = F.col("p_partkey").cast("string"), F.col("p_partkey")
    m, right = (key % 4).cast("string"), lambda k, x, y: F.when(key % k > 0, x).otherwise(y)
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    # dealt to all tasks: judging a row takes far longer than reading it
    rows = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).select(
        key.alias("id"), text("\\frac{11+", n, "a}{20}").alias("a"), right(3, text("\\frac{", n, "a+11}{20}"), text("\\frac{", n, "a+12}{20}")).alias("b"),
        text("(x+", n, ")^2").alias("c"), right(2, text("x^2+3\\cdot ", n, "x+", n, "^2"), text("x^2+2\\cdot ", n, "x+", n, "^2")).alias("e"), text(m, "y+1").alias("f"),
        text("(x+1)^{", n, "}").alias("g"), right(5, text("(1+x)^{", (key - 1).cast("string"), "}(x+1)"), text("x^{", n, "}+1")).alias("h"),
        text("\\sin(", n, "x)").alias("i"), right(2, text(n, "\\sin x"), text("\\sin ", n, "x")).alias("j"),
        text("\\sqrt{", (key * key * 12).cast("string"), "}").alias("k"), right(7, text(n, "\\sqrt{3}+", n, "\\sqrt{3}"), text(n, "\\sqrt{12}+1")).alias("l"))
    same = lambda x, y: A.equivalent(F.col(x), F.col(y), symbolic=symbolic_equal)
    moved = A.equivalent(F.col("f"), F.lit("1+y"), symbolic=symbolic_equal)
    return rows.select("id", same("a", "b").alias("same"), same("c", "e").alias("square"), moved.alias("moved"), same("g", "h").alias("power"), same("i", "j").alias("sine"), same("k", "l").alias("root"))


@query(r"SELECT row_idx, trim(regexp_extract(generated, '\\boxed\{([^}]*)\}', 1)) AS first, row_idx || '-' || dataset AS key, round(1 / (1 + exp(-token_count / 1000.0::DOUBLE)), 9) AS s FROM answers WHERE regexp_matches(generated, '\\boxed\{([^}]*)\}')")
def q_functions_in_sql(spark, d):
    sql.register(spark)
    views.answers(spark, d).createOrReplaceTempView("answers_of_q_functions_in_sql")
    return spark.sql("SELECT row_idx, boxed_first(generated) AS first, pair_key(cast(row_idx AS string), dataset) AS key, round(sigmoid(token_count / 1000d), 9) AS s FROM answers_of_q_functions_in_sql WHERE boxed_first(generated) IS NOT NULL")


@query("""
SELECT g, list_transform([regr_intercept(y, x), regr_slope(y, x)], lambda c: round(c, 6)) AS line, [2.0::DOUBLE, -3.0::DOUBLE, 0.5::DOUBLE, CAST(g - 2 AS DOUBLE), 0.25::DOUBLE, -0.125::DOUBLE] AS quintic
FROM (SELECT question_id % 5 AS g, CAST(row_idx % 11 AS DOUBLE) AS x, CAST(generated_think_tokens AS DOUBLE) AS y FROM runs) GROUP BY g
""")
def q_polyfit_any_degree(spark, d):
    """A line through all runs of a group, and the polynomial of degree 5 that made each of its values."""
    x, g = F.col("x"), F.col("g")
    p = views.runs(spark, d).select((F.col("question_id") % 5).alias("g"), (F.col("row_idx") % 11).cast("double").alias("x"), F.col("generated_think_tokens").alias("y"))
    made = p.withColumn("y", 2 - 3 * x + 0.5 * x * x + (g - 2) * F.pow(x, F.lit(3)) + 0.25 * F.pow(x, F.lit(4)) - 0.125 * F.pow(x, F.lit(5)))
    rounded = lambda df, n: F.transform(df["coefficients"], lambda c: F.round(c, n) + 0.0)
    line, quintic = metrics.polynomial_fit(p, "x", "y", 1, "g"), metrics.polynomial_fit(made, "x", "y", 5, "g")
    return line.select("g", rounded(line, 6).alias("line")).join(quintic.select("g", rounded(quintic, 4).alias("quintic")), "g")


@query("""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY row_idx) AS n,
  CASE WHEN coalesce(is_correct, false) THEN 'end' WHEN abs(generated_think_tokens - target_think_tokens) <= 150 THEN 'tolerance' END AS why FROM runs),
f AS (SELECT question_id, min(n) FILTER (why IS NOT NULL) AS first, max(n) AS n FROM s GROUP BY 1),
stop AS (SELECT question_id, CASE WHEN first <= 6 THEN first WHEN n >= 6 THEN 6 END AS n FROM f)
SELECT a.question_id, s.row_idx AS stopped_at, CASE WHEN a.n IS NULL THEN 'open' ELSE coalesce(s.why, 'max_steps') END AS reason FROM stop a LEFT JOIN s ON s.question_id = a.question_id AND s.n = a.n
""")
def q_stop_loop(spark, d):
    return trajectory.stopped(views.runs(spark, d), "question_id", "row_idx", "generated_think_tokens", "target_think_tokens", "is_correct", 150, 6)


@query("SELECT row_idx, question_id, generated_think_tokens + 1 AS tokens FROM runs")
def q_run_stream(spark, d):
    """All runs, worked off as a stream of files in two calls, the second of which finds what came after the first."""
    at, r = _folder(spark), views.runs(spark, d).select("row_idx", "question_id", "generated_think_tokens")
    stage = lambda rows: rows.select("row_idx", "question_id", (F.col("generated_think_tokens") + 1).alias("tokens"))
    for part in (0, 1):
        r.where(F.pmod(F.xxhash64("row_idx"), F.lit(2)) == part).write.mode("append").parquet(f"{at}/work")
        tables.run_stream(spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/work"), stage, f"{at}/done", f"{at}/log")
    return tables.read_stream_results(spark, f"{at}/done")


_SECOND = " OR ".join(f"contains(lower(token_id), '{w}')" for w in X.SECOND_THOUGHTS)


@query(f"SELECT DISTINCT token_id, -100.0::DOUBLE AS bias FROM (SELECT unnest(string_split(text, ' ')) AS token_id FROM documents) WHERE {_SECOND}")
def q_suppressed_ids(spark, d):
    """Of all that stands between blanks in documents, as a vocabulary, what generation is kept from, with its bias."""
    token = F.explode(F.split("text", " ", -1)).alias("token")
    words = table(spark, d, "documents").select(token).distinct().select("token", F.col("token").alias("token_id"))
    return lifecycle.suppressed_ids(words).withColumn("bias", F.col("bias").cast("double"))


# Vectors.


@query("""
SELECT row_idx, min(b) AS budget, count(*) AS budgets_left FROM runs JOIN (SELECT CAST(trunc(100 + i * 4900 / 19.0) AS INTEGER) AS b FROM range(20) t(i)) ON b >= generated_think_tokens GROUP BY row_idx
UNION ALL SELECT row_idx, NULL, 0 FROM runs WHERE generated_think_tokens > 5000
""")
def q_truncated_grid(spark, d):
    """The least budget of a truncated grid that each run's tokens fit in, and how many of its budgets they fit in."""
    enough = F.filter(F.array(*map(F.lit, V.truncated_grid(100, 5000, 20))), lambda b: b >= F.col("generated_think_tokens"))
    return views.runs(spark, d).select("row_idx", F.get(enough, F.lit(0)).cast("int").alias("budget"), F.size(enough).cast("long").alias("budgets_left"))


@query("SELECT row_idx, [CAST((row_idx % 2048) / 1024.0 AS FLOAT), -CAST(row_idx % 2048 AS FLOAT)] AS v FROM runs")
def q_half_precision(spark, d):
    n = (F.col("row_idx") % 2048).cast("double")
    # what 16 bits can hold stays; a trace too small for them goes
    return views.runs(spark, d).select("row_idx", V.half_precision(F.array(n / 1024 + F.when(n > 1024, F.lit(1e-5)).otherwise(F.lit(0.0)), -n)).alias("v"))


@query("SELECT row_idx, round(generated_think_tokens / nullif(row_idx % 3, 0), 9) AS latency, abs(generated_think_tokens - target_think_tokens) <= 50 OR coalesce(is_correct, false) AS stops FROM runs")
def q_latency_and_stops(spark, d):
    r, t = views.runs(spark, d), F.col("generated_think_tokens")
    return r.select("row_idx", F.round(V.unbatched_latency(t.cast("double"), F.col("row_idx") % 3), 9).alias("latency"), V.stops(t, F.col("target_think_tokens"), 50, F.coalesce("is_correct", F.lit(False))).alias("stops"))


@query(f"SELECT vec_id, {', '.join(f'round(1 / (1 + exp(-z[{i + 1}])), 6) AS b{(i + 1) * 100}' for i in range(_BINS))} FROM ({_MLP})")
def q_probability_columns(spark, d):
    z = network.logits(table(spark, d, "embeddings").select("vec_id", "embedding"), small_network(), "embedding", "z")
    bins = [(i + 1) * 100 for i in range(_BINS)]
    wide = z.select("vec_id", *network.probability_columns(network.probabilities(F.col("z")), bins))
    return wide.select("vec_id", *(F.round(F.col(f"`{b}`"), 6).alias(f"b{b}") for b in bins))


@query("SELECT vec_id, embedding[1] > 0 AS first, embedding[2] > 0 AS second FROM embeddings WHERE abs(embedding[1]) > 0.05 AND abs(embedding[2]) > 0.05")
def q_trained_network(spark, d):
    """Signs that a network, fitted to those of the first two components, sees in all rows where both are clear."""
    at = [F.get("embedding", F.lit(i)) for i in (0, 1)]
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("hidden"), F.array(*((x > 0).cast("int") for x in at)).alias("y"), *(F.abs(x).alias(n) for n, x in zip("ab", at)))
    layers = network.train(e, (8, 2), epochs=40, batch=1 << 20, dropout=0.0, rate=3e-1, negative=1.0)
    z = network.logits(e.where("a > 0.05 and b > 0.05"), layers, "hidden", "z")
    return z.select("vec_id", *((F.get("z", F.lit(i)) > 0).alias(n) for i, n in enumerate(("first", "second"))))


@query("""
SELECT doc_id, list_transform(range(16), lambda i: (instr('123456789abcdef', h[2 * i + 1]) * 16 + instr('123456789abcdef', h[2 * i + 2]))::INTEGER) AS hidden
FROM (SELECT doc_id, sha256('0:' || coalesce(text, '')) AS h FROM documents)
""")
def q_embedded_once(spark, d):
    """Stand-ins for hidden states, a vector for every row: bytes of a hash of its text, as 16-bit fractions."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    v = providers.embedded(docs, lambda: providers.stub_embed(16))
    return v.select("doc_id", F.transform(V.half_precision(F.col("hidden")), lambda x: F.round((x + 0.5) * 255).cast("int")).alias("hidden"))
