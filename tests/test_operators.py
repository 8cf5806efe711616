"""Small cases of table operators, sources and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenledger import schema
from tokenledger.functions import vectors as V
from tokenledger.operators import joins, labels, metrics, network, prep, providers, repair, trajectory, validate
from tokenledger.sources import npy, tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_grids():
    assert V.BUDGETS == [100, 357, 615, 873, 1131, 1389, 1647, 1905, 2163, 2421, 2678, 2936, 3194, 3452, 3710, 3968, 4226, 4484, 4742, 5000]
    assert V.OLD_BUDGETS == [100, 366, 633, 900, 1166, 1433, 1700, 1966, 2233, 2500]


@pytest.mark.parametrize("p, threshold, budget, hard", [([0.2, 0.6, 0.9], 0.5, 357, False), ([0.2, 0.6, 0.9], 0.8, 615, False), ([0.1, 0.3, 0.2], 0.5, 357, True), ([0.4, 0.4, 0.1], 0.5, 100, True)])
def test_budget_choice(spark, p, threshold, budget, hard):
    df = spark.createDataFrame([(p,)], "p array<double>")
    pick = lambda mode: tuple(df.select(V.choose_budget(F.col("p"), V.BUDGETS[:3], threshold, mode)).first()[0])
    assert pick("likeliest") == (budget, hard)
    assert pick("last") == (615 if hard else budget, hard)
    assert pick("null") == (None if hard else budget, hard)


def test_label_matrix_and_classes(spark):
    r = spark.createDataFrame([("q", 100, "True", 0), ("q", 100, "False", 1), ("q", 615, "no", 2), ("s", 357, " true", 3)], "question_id string, target_think_tokens int, is_correct string, row_idx int")
    m = labels.label_matrix(r, V.BUDGETS[:3])
    assert rows(m, "question_id") == [("q", [1, 0, 0]), ("s", [0, 1, 0])]
    assert rows(m.select(V.first_correct_class(F.col("y"))), "question_id") == [(0,), (1,)]
    assert spark.range(1).select(V.first_correct_class(F.array(F.lit(0), F.lit(0), F.lit(0)))).first()[0] == 3


def test_collapse_of_steps(spark):
    s = "question_id string, step_i int, is_correct boolean, actual_tokens int, bin_1 double, problem string"
    made = lambda *v: spark.createDataFrame([("q", i, x, 10 * i, 0.1, "p") for i, x in enumerate(v)], s)
    assert rows(labels.collapse_steps(made(None, True, True))) == [("q", True, 10)]
    assert rows(labels.collapse_steps(made(None, None))) == [("q", None, 10)]
    with pytest.raises(Exception, match="different verdicts"):
        labels.collapse_steps(made(True, False)).collect()
    assert labels.collapse_steps(spark.createDataFrame([], s)).count() == 0


def test_first_rows(spark):
    d = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("b", 3, 3.0)], "k string, i int, v double")
    assert rows(prep.first_non_null(d, ["k"], "i"), "k") == [("a", None), ("b", 3.0)]
    assert rows(prep.keep_first(d, ["k"], "i"), "k") == [("a", 1, None), ("b", 2, None)]


def test_decontamination(spark, monkeypatch):
    d = spark.createDataFrame([(1, "x" * 40 + "needle in the hay" + "y" * 40), (2, "needle"), (3, "none of it"), (4, None), (5, "hay stack that is long enough to have a key of its own")], "id int, problem string")
    e = spark.createDataFrame([("a needle in the hay",), ("here " + "x" * 40 + "needle in the hay" + "y" * 40 + " there",)], "text string")
    assert rows(prep.drop_contained(d, e).select("id"), "id") == [(3,), (4,), (5,)]
    monkeypatch.setattr(prep, "BROADCAST_BYTES", 0)
    for keys in (1_000_000, 0):
        monkeypatch.setattr(prep, "BROADCAST_KEYS", keys)
        assert rows(prep.drop_contained(d, e).select("id"), "id") == [(3,), (4,), (5,)]
    assert rows(prep.drop_exact(d, spark.createDataFrame([("needle",)], "text string")).select("id"), "id") == [(1,), (3,), (4,), (5,)]


@pytest.mark.parametrize("limits", [{"BROADCAST_BYTES": 0}, {"BROADCAST_BYTES": 0, "BROADCAST_KEYS": 0}, {}, {"AUTOMATON_BYTES": 2000}])
def test_contained_texts_by_brute_force(spark, monkeypatch, limits):
    """Common openings, texts of a piece's length and around it, repeats, empty texts and nulls; by pieces and by automata."""
    for name, value in limits.items():
        monkeypatch.setattr(prep, name, value)
    rng = np.random.default_rng(5)
    opening = "Let x and y be real numbers such that "
    prompts = [opening + "".join(rng.choice(list("abé "), rng.integers(0, 80))) for _ in range(60)] + ["short", "", None]
    cuts = [(p or "")[a : a + n] for p in prompts for a, n in zip(rng.integers(0, 60, 4), rng.integers(0, 100, 4))]
    texts = [*cuts, *(c + "#" for c in cuts[:40]), *prompts, opening, opening + "z" * 40, None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, problem string")
    got = {r[0] for r in prep.drop_contained(d, spark.createDataFrame([(p,) for p in prompts], "text string")).select("id").collect()}
    assert got == {i for i, t in enumerate(texts) if t is None or not any(t in p for p in prompts if p is not None)}
    clashing = prep.drop_contained(d.withColumn("_prompt", F.lit(1)).withColumn("_text", F.lit(2)), spark.createDataFrame([("short", 1)], "text string, _text int"))
    assert clashing.columns == ["id", "problem", "_prompt", "_text"] and clashing.count() == len(texts) - sum(t is not None and t in "short" for t in texts)
    assert "NestedLoop" not in clashing._jdf.queryExecution().executedPlan().toString()
    assert prep.drop_contained(d, spark.createDataFrame([(None,)], "text string")).count() == len(texts)


def test_splits_and_order(spark):
    d = spark.createDataFrame([("AIME-1",), ("12",), (None,)], "id string")
    hit, rest = prep.split_by_pattern(d, "id", "aime")
    assert rows(hit) == [("AIME-1",)] and rest.count() == 2
    assert prep.first_half(spark.range(5).withColumnRenamed("id", "row_idx")).count() == 2
    assert rows(prep.fixed_order(d, "id", ["12", "AIME-1"])) == [("12",), ("AIME-1",), (None,)]
    out, kept = prep.hash_split(spark.range(1000), "id", 0.1)
    assert out.count() + kept.count() == 1000 and 50 < out.count() < 160
    assert prep.known_level(spark.createDataFrame([("?",), (None,), ("3",)], "level string")).count() == 2
    assert rows(prep.missing_ids(spark.createDataFrame([(0,), (2,), (5,)], "id long")), "id") == [(1,)]
    assert prep.shuffled(spark.range(5), "id", 1).count() == 5


def test_guards(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(ValueError, match="more than once"):
        joins.attach(a, b, "k")
    with pytest.raises(Exception, match="no v for k 2"):
        joins.strict_lookup(a, b.withColumn("i", F.col("v")), "k", "v", "i").collect()
    assert rows(joins.strict_lookup(a.where("k = 1"), b.withColumn("i", F.col("v")), "k", "v", "i")) == [(1, 6)]
    with pytest.raises(ValueError):
        validate.require_same_count(a, a.limit(1))
    with pytest.raises(ValueError):
        validate.require_columns(a, "x")
    with pytest.raises(ValueError):
        validate.require_none(a, "rows")
    assert joins.by_position(a, a.withColumn("w", F.lit(0)), "k").count() == 2
    assert rows(validate.duplicate_keys(b, "k")) == [(1, 2)]
    assert validate.without_answer(spark.createDataFrame([("x",), (r"\boxed{}",)], "t string"), "t").count() == 1
    calls = joins.once_per_text(spark.createDataFrame([("a",), ("a",), (None,)], "t string"), "t", lambda d: d.withColumn("n", F.length("t")))
    assert rows(calls, "t") == [(None, None), ("a", 1), ("a", 1)]


def test_histograms(spark):
    d = spark.createDataFrame([(50,), (100,), (2500,), (2600,)], "x int")
    assert rows(metrics.percentage_histogram(d, "x", [100, 366, 2500]), "bin") == [(0, 0.25), (1, 0.25)]
    assert rows(metrics.histogram_2d(d.withColumn("y", F.lit(1)), "x", "y", 2), "bx") == [(0, 0, 2), (1, 0, 2)]
    assert metrics.histogram_2d(d.limit(0).withColumn("y", F.lit(1)), "x", "y", 2).count() == 0


def test_summaries(spark):
    d = spark.createDataFrame([("m", "a", True, 10, False), ("m", "a", False, 30, True), ("m", "b", None, 5, False)], "model string, dataset string, is_correct boolean, token_count int, hallucinated boolean")
    s = metrics.model_dataset_summary(d, "model", "dataset")
    assert rows(s, "dataset") == [("m", "a", 2, 1, 0.5, 20.0, 10.0, 1), ("m", "b", 1, 0, 0.0, 5.0, 5.0, 0)]
    r = metrics.report(s, ["b", "a"], ["accuracy"])
    assert r.columns == ["model", "accuracy__b", "accuracy__a"] and rows(r) == [("m", 0.0, 0.5)]
    assert rows(metrics.accuracy_and_tokens(d)) == [(50.0, 15.0)]
    assert rows(metrics.value_counts(d, "is_correct"), "is_correct") == [(False, 1), (True, 1)]
    assert rows(metrics.class_metrics(spark.createDataFrame([(1, 1), (0, 1)], "p int, t int"), "p", "t", 3), "class") == [(0, 0, 1.0), (1, 2, 0.5), (2, 0, 1.0)]


def test_fit(spark):
    d = spark.createDataFrame([(float(x), 2.0 * x * x - 3 * x + 1) for x in range(6)], "x double, y double").withColumn("g", F.lit(1))
    fit = metrics.quadratic_fit(d, "x", "y", "g")
    assert np.allclose(rows(fit)[0][1:], [2, -3, 1])
    assert rows(metrics.quadratic_fit(d.where("x < 2"), "x", "y", "g")) == [(1, None, None, None)]
    assert np.allclose([r[2] for r in rows(metrics.curve_points(fit, 0, 4, 3, "g"), "x")], [1, 3, 21])


def test_repairs(spark):
    d = spark.createDataFrame([("7", "p1", 0), ("7", "p2", 1), ("9", "p3", 2)], "question_id string, prompt string, row_idx int")
    assert rows(repair.split_ids(d), "row_idx") == [("7", "p1", 0), ("10", "p2", 1), ("9", "p3", 2)]
    padded = repair.pad_groups(d, 3)
    assert padded.count() == 9 and padded.where("row_idx is null").count() == 6
    assert repair.pad_groups(d, 1).count() == 3


def test_trajectories(spark):
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 3, 2, 5, 4])], "k string, s int, v double")
    x = np.array([1, 3, 2, 5, 4.0]) - 3
    acf = [r[2] for r in rows(trajectory.autocorrelation(d, "k", "s", "v"), "lag")]
    assert np.allclose(acf, [(x[: 5 - k] * x[k:]).sum() / (x * x).sum() for k in range(5)])
    assert rows(trajectory.autocorrelation(d.limit(1), "k", "s", "v")) == [("a", 0, None)]
    f, p = trajectory.periodogram(np.sin(np.arange(64) * 2 * np.pi / 8))
    assert f[p.argmax()] == 0.125
    assert trajectory.power_spectrum(d, "k", "s", "v").count() == 3
    assert rows(trajectory.numbered_batches(d.withColumn("row_idx", F.col("s")), 2).select("batch"), "s") == [(0,), (0,), (1,), (1,), (2,)]
    assert rows(trajectory.mean_absolute(trajectory.autocorrelation(d, "k", "s", "v")), "lag")[0] == (0, 1.0)


def fitted(x, y, layers, kind, steps, rate, decay, negative):
    """AdamW over all rows at once, one after the other."""
    layers = [[np.array(w), np.array(b)] for w, b in layers]
    moments, beta = [[[0 * p, 0 * p] for p in layer] for layer in layers], (0.9, 0.999)
    for step in range(1, steps + 1):
        held = [x.astype(float)]
        for w, b in layers[:-1]:
            held.append(np.maximum(held[-1] @ w + b, 0))
        z = held[-1] @ layers[-1][0] + layers[-1][1]
        if kind == "sigmoid":
            g = (1 / (1 + np.exp(-z)) - y) * np.where(y > 0, 1, negative) / y.size
        else:
            g = (np.exp(z) / np.exp(z).sum(1, keepdims=True) - y) / len(y)
        for i in reversed(range(len(layers))):
            own, below = (held[i].T @ g, g.sum(0)), (g @ layers[i][0].T) * (held[i] > 0)
            for j in (0, 1):
                m, v = moments[i][j] = [b * old + (1 - b) * new for b, old, new in zip(beta, moments[i][j], (own[j], own[j] ** 2))]
                layers[i][j] = layers[i][j] * (1 - rate * decay) - rate * (m / (1 - beta[0] ** step)) / (np.sqrt(v / (1 - beta[1] ** step)) + 1e-8)
            g = below
    return layers


@pytest.mark.parametrize("kind,direct", [("sigmoid", 16), ("softmax", 2)])
def test_training_where_the_rows_are(spark, monkeypatch, kind, direct):
    """The same network as one fitted in one place, whether sums come to the driver directly or by groups."""
    monkeypatch.setattr(network, "TASK_ROWS", 10)
    monkeypatch.setattr(network, "DIRECT", direct)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 5)).astype(np.float32)
    x[100:] = x[:50]  # repeated rows
    y = np.eye(3)[np.argmax(x[:, :3], 1)] if kind == "softmax" else (x[:, :3] > 0).astype(float)
    data = spark.createDataFrame([(a.tolist(), [int(v) for v in b]) for a, b in zip(x, y)] + [(None, [1, 0, 0]), (x[0].tolist(), None)], "hidden array<float>, y array<int>")
    got = network.train(data, (5, 8, 3), kind, epochs=6, batch=1000, dropout=0.0, rate=1e-2, decay=1e-2, negative=2.5, seed=4)
    want = fitted(x, y, network.init_network((5, 8, 3), 4), kind, 6, 1e-2, 1e-2, 2.5)
    assert all(np.allclose(p, q, atol=1e-6) for a, b in zip(got, want) for p, q in zip(a, b))
    again = network.train(data, (5, 8, 3), kind, epochs=2, batch=40, dropout=0.3, seed=4)
    once = network.train(data, (5, 8, 3), kind, epochs=2, batch=40, dropout=0.3, seed=4)
    assert all(np.array_equal(p, q) for a, b in zip(again, once) for p, q in zip(a, b))


def test_network_learns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    data = spark.createDataFrame([(v.tolist(), [int(v[0] > 0), int(v[1] > 0)]) for v in x], "hidden array<float>, y array<int>")
    layers = network.train(data, (4, 16, 2), epochs=60, batch=50, dropout=0.0, rate=1e-2)
    scored = network.logits(data, layers, "hidden")
    assert metrics.binary_metrics(scored, "logits", "y").first()["accuracy"] > 0.9
    native = [r[0] for r in data.limit(5).select(network.logits_native(F.col("hidden"), layers)).collect()]
    assert np.allclose(native, network.forward(layers, np.array([r[0] for r in data.limit(5).collect()])), atol=1e-5)
    soft = network.train(data.withColumn("y", F.when(F.col("y")[0] == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0)))), (4, 8, 2), "softmax", epochs=60, batch=50, dropout=0.1, rate=1e-2)
    assert (network.forward(soft, x.astype(float)).argmax(1) == (x[:, 0] > 0)).mean() > 0.9
    assert len(network.train(data.limit(0), (4, 2))) == 1


def test_half_precision(spark):
    v = [0.1, 1 / 3, 65504.0, 1e-7, -2.5, 0.0, -0.0, -1e-9]
    got = spark.createDataFrame([(v,)], "v array<double>").select(V.half_precision(F.col("v"))).first()[0]
    want = np.array(v).astype(np.float16).astype(np.float32)
    assert np.array_equal(np.array(got, np.float32), want) and np.array_equal(np.signbit(got), np.signbit(want))


def test_sources_and_sinks(spark, tmp_path):
    empty = tables.read_batches(spark, str(tmp_path / "none"), schema.TARGET_TOKENS)
    assert empty.count() == 0 and empty.schema == schema.TARGET_TOKENS
    tables.write_parquet(spark.createDataFrame([(1, 2)], schema.TARGET_TOKENS), str(tmp_path / "t"))
    assert tables.read_batches(spark, str(tmp_path / "t"), schema.TARGET_TOKENS).count() == 1
    assert tables.read_parquet(spark, str(tmp_path / "t"), ["id"]).columns == ["id"]
    assert tables.read_existing(spark, {"a": str(tmp_path / "t"), "b": str(tmp_path / "none")}).select("name").first()[0] == "a"
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.csv").write_text("q1,Level 3,5,true,m\n")
    assert rows(tables.read_csv(spark, str(tmp_path / "c"), schema.OTHER_RESULTS, header=False)) == [("q1", "Level 3", 5, True, "m")]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert tables.read_json_lines(spark, str(tmp_path / "j.jsonl")).count() == 2
    np.save(tmp_path / "v.npy", np.array([[[0.5, 1.5]], [[2.5, 3.5]]], np.float16))
    assert rows(npy.read_npy(spark, str(tmp_path / "v.npy")).select("row_idx", "vector"), "row_idx") == [(0, [0.5, 1.5]), (1, [2.5, 3.5])]
    tables.save_network(spark, [(np.eye(2), np.zeros(2))], str(tmp_path / "n"), bins=3)
    layers, about = tables.load_network(spark, str(tmp_path / "n"))
    assert layers[0][0] == [[1, 0], [0, 1]] and about == {"bins": 3}
    tables.write_runs(spark.createDataFrame([("aime", 1)], "dataset string, v int"), str(tmp_path / "r"), "m_tale")
    assert spark.read.parquet(str(tmp_path / "r")).columns == ["v", "run_name", "dataset"]
    assert tables.problem_column(spark.createDataFrame([(1,)], "Question int")) == "Question"
    with pytest.raises(ValueError):
        tables.problem_column(spark.range(1))


def test_resumable_stage(spark, tmp_path):
    seen = []

    def stage(d):
        seen.append(d.count())
        return d.withColumn("v", F.col("id") + 1)

    where = str(tmp_path / "out")
    assert tables.run_resumable(spark.range(6), stage, where, "id").count() == 6
    assert tables.run_resumable(spark.range(10), stage, where, "id", batches=2).count() == 10
    assert sum(seen) == 10


def test_positions_are_dense(spark):
    d = spark.createDataFrame([(x,) for x in "hgfedcba"], "k string")
    assert rows(tables.with_position(d, "k"), "k") == [(c, i) for i, c in enumerate("abcdefgh")]


def test_providers(spark):
    d = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    g = providers.generated(d, lambda: providers.stub_generate, batch=2)
    assert g.count() == 3 and g.select("generated").distinct().count() == 2 and g.where("latency_sec >= 0").count() == 3
    e = providers.embedded(d, lambda: providers.stub_embed(4))
    assert e.count() == 3 and e.where(F.size("hidden") == 4).count() == 3


def test_streaming_collapse(spark, tmp_path):
    from tokenledger.streaming.runs import latest_verdicts

    s = "question_id string, step_i int, is_correct boolean"
    spark.createDataFrame([("q", 0, None), ("q", 1, True), ("s", 0, None)], s).write.parquet(str(tmp_path / "in"))
    stream = latest_verdicts(spark.readStream.schema(s).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("verdicts").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert rows(spark.table("verdicts"), "question_id") == [("q", True, 2), ("s", None, 1)]


def test_npy_files(spark, tmp_path):
    """Files of many partitions, folders, odd kinds, empty arrays, and what must be refused."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5000, 3, 4)).astype(np.float16)
    np.save(tmp_path / "a.npy", a)
    got = npy.read_npy(spark, str(tmp_path / "a.npy"), partition_bytes=10_000)
    assert got.rdd.getNumPartitions() == -(-5000 // (10_000 // 24))
    found = got.orderBy("row_idx").select("row_idx", "vector").toArrow()
    assert found["row_idx"].to_pylist() == list(range(5000)) and np.array_equal(np.array(found["vector"].to_pylist(), np.float32), a.reshape(5000, 12).astype(np.float32))
    (tmp_path / "d").mkdir()
    for name, x in (("x", np.arange(7)), ("y", np.zeros((0, 4))), ("z", np.ones((2, 1), ">i2"))):
        np.save(tmp_path / "d" / f"{name}.npy", x)
    assert sorted((r["path"][-5:], r["row_idx"], r["vector"]) for r in npy.read_npy(spark, f"file://{tmp_path}/d").collect()) == [*(("x.npy", i, [float(i)]) for i in range(7)), ("z.npy", 0, [1.0]), ("z.npy", 1, [1.0])]
    for name, x in (("columns", np.asfortranarray(a[:, :, 0])), ("objects", np.array([{}], dtype=object)), ("one", np.float32(3))):
        np.save(tmp_path / f"{name}.npy", x, allow_pickle=True)
        with pytest.raises(Exception, match="column by column|Python objects|one number"):
            npy.read_npy(spark, str(tmp_path / f"{name}.npy")).collect()


def test_npy_writing(spark, tmp_path):
    df = spark.range(3000).select("id", F.array((F.col("id") % 7).cast("double"), -F.col("id").cast("double"), F.lit(0.1)).alias("v ec")).repartition(6)
    for dtype in ("<f4", "<f8", "<f2"):
        npy.write_npy(df, str(tmp_path / "w.npy"), "v ec", "id", dtype=dtype)
        want = np.array([[i % 7, -i, 0.1] for i in range(3000)]).astype(dtype)
        assert np.array_equal(np.load(tmp_path / "w.npy"), want) and np.load(tmp_path / "w.npy").dtype == np.dtype(dtype)
    assert [p.name for p in tmp_path.iterdir()] == ["w.npy"]  # no parts are left
    npy.write_npy(df.limit(0), str(tmp_path / "none.npy"), "v ec", "id")
    assert np.load(tmp_path / "none.npy").shape[0] == 0
    for bad in ("array(1.0) || if(id = 5, array(2.0), array())", "if(id = 7, null, array(1.0))", "array(if(id = 9, null, 1.0))"):
        with pytest.raises(Exception, match="differ in length, or are null"):
            npy.write_npy(df.withColumn("v ec", F.expr(bad)), str(tmp_path / "bad.npy"), "v ec", "id")
    assert not (tmp_path / "bad.npy").exists() and not [p for p in tmp_path.iterdir() if "parts" in p.name]


class Evil:
    def __reduce__(self):
        return (print, ("run",))


def test_pickled_dictionaries(spark, tmp_path):
    np.save(tmp_path / "d.npy", {"12-aime": 300, "7-gsm8k": np.int64(5), 3: np.float32(0.5)}, allow_pickle=True)
    assert rows(npy.read_npy_dictionary(spark, str(tmp_path / "d.npy")), "key") == [("12-aime", 300.0), ("3", 0.5), ("7-gsm8k", 5.0)]
    for bad in ({"x": Evil()}, [1, 2], {"x": "text"}):
        np.save(tmp_path / "e.npy", bad, allow_pickle=True)
        with pytest.raises(Exception, match="not allowed|not a pickled|convert"):
            npy.read_npy_dictionary(spark, str(tmp_path / "e.npy")).collect()


def test_fits_of_any_degree(spark):
    rng = np.random.default_rng(3)
    data = [("a", x, float(np.sin(x / 9))) for x in rng.uniform(1e6, 1e6 + 40, 300).tolist()] + [("b", float(x), float(x**2)) for x in range(3)] + [("c", 5.0, 1.0)] * 4 + [("c", None, 2.0), (None, 1.0, 1.0), (None, 2.0, 3.0)]
    d = spark.createDataFrame(data, "k string, x double, y double")
    for degree in (0, 1, 2, 3, 7):
        fits = {r["k"]: r for r in metrics.polynomial_fit(d, "x", "y", degree, "k").collect()}
        got = {k: r["coefficients"] for k, r in fits.items()}
        x, y = (np.array(v) for v in zip(*[(r[1], r[2]) for r in data if r[0] == "a"]))
        want = np.polynomial.Polynomial.fit(x, y, degree)
        at = np.linspace(x.min(), x.max(), 50)
        assert np.allclose(np.polynomial.Polynomial(fits["a"]["centred"])(at - fits["a"]["middle"]), want(at), atol=1e-8)
        if degree < 3:  # written out far from 0, higher powers cancel
            assert np.allclose(np.polynomial.Polynomial(got["a"])(at), want(at), atol=1e-3)
        assert (got["b"] is None) == (degree > 2) and (got["c"] is None) == (degree > 0) and (got[None] is None) == (degree > 1)
    assert np.allclose({r["k"]: r["coefficients"] for r in metrics.polynomial_fit(d, "x", "y", 2, "k").collect()}["b"], [0, 0, 1], atol=1e-9)
    whole = metrics.polynomial_fit(d.where("k = 'b'"), "x", "y", 1).first()
    assert np.allclose(whole["coefficients"], [-1 / 3, 2]) and whole["places"] == 3
    assert metrics.polynomial_fit(d.limit(0), "x", "y", 2, "k").count() == 0


def test_stops_step_by_step(spark):
    steps = [("a", 1, 10, 100, None), ("a", 2, 95, 100, None), ("a", 3, 100, 100, True), ("b", 1, 1, 100, False), ("b", 2, 2, 100, True), ("c", 3, 1, 9, None), ("c", 1, 1, 9, None), ("c", 2, None, 9, None), ("c", 4, 9, 9, None), ("d", 1, 1, 9, None), ("e", 1, 9, 9, True)]
    d = spark.createDataFrame(steps, "k string, s int, actual int, target int, ended boolean").repartition(3)
    assert rows(trajectory.stopped(d, "k", "s", "actual", "target", "ended", 5, 3), "k") == [("a", 2, "tolerance"), ("b", 2, "end"), ("c", 3, "max_steps"), ("d", None, "open"), ("e", 1, "end")]
    assert trajectory.stopped(d.limit(0), "k", "s", "actual", "target", "ended", 5, 3).count() == 0


def test_a_killed_run_goes_on(spark, tmp_path):
    """A crash between a batch's writing and its entry in the log, and one within a batch: no row is lost or comes twice."""
    at = str(tmp_path)
    seen = []

    def run(fail_at=None):
        def stage(part):
            seen.append(part.count())
            if fail_at == len(seen):
                part.limit(1).write.mode("append").parquet(f"{at}/done/batch={len(seen) - 1}")  # what a killed task may leave
                raise RuntimeError("killed")
            return part.withColumn("twice", F.col("id") * 2)

        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{at}/work")
        tables.run_stream(source, stage, f"{at}/done", f"{at}/log")

    spark.range(40).repartition(4).write.parquet(f"{at}/work")
    with pytest.raises(Exception, match="killed"):
        run(fail_at=3)
    run()
    spark.range(40, 50).write.mode("append").parquet(f"{at}/work")
    run()
    run()
    assert sorted(map(tuple, tables.read_stream_results(spark, f"{at}/done").collect())) == [(i, 2 * i) for i in range(50)]
    assert sum(seen) < 50 + 25  # what was done wasn't done again


def test_results_kept_from_run_to_run(spark, tmp_path):
    seen, at = [], str(tmp_path / "kept")

    def stage(texts):
        seen.append(sorted(r[0] for r in texts.collect()))
        return texts.withColumn("n", F.length("t"))

    d = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert rows(joins.cached_per_text(d("a", "bb", "a", None), "t", stage, "kept_texts", at, 4), "id") == [(0, "a", 1), (1, "bb", 2), (2, "a", 1), (3, None, None)]
    again = joins.cached_per_text(d("bb", "ccc", "", "ccc"), "t", stage, "kept_texts", at, 4)
    assert rows(again, "id") == [(0, "bb", 2), (1, "ccc", 3), (2, "", 0), (3, "ccc", 3)]
    spark.sql("DROP TABLE kept_texts")  # as in another session: the files stay
    assert joins.cached_per_text(d("ccc", "a"), "t", stage, "kept_texts", at, 4).count() == 2
    assert seen == [["a", "bb"], ["", "ccc"], []]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 1  # the cache's rows are not shuffled
    spark.sql("DROP TABLE kept_texts")


def test_questions_close_by_the_watermark(spark, tmp_path):
    """First verdicts over several batches, late steps, differing verdicts, and a question that comes again."""
    from datetime import datetime, timedelta

    from tokenledger.streaming.runs import collapse_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    batches = [
        [("a", 2, None, at(0)), ("a", 5, True, at(1)), ("b", 1, None, at(2)), ("d", 1, True, at(2))],
        [("a", 3, True, at(3)), ("b", 9, None, at(3)), ("d", 2, False, at(4))],  # an earlier step with a verdict, in a later batch
        [("c", 1, False, at(100))],  # the watermark moves to 90: a, b and d close
        [("a", 1, False, at(20)), ("c", 2, None, at(101)), ("a", 7, False, at(99))],  # one late step of a, and one in time
        [("z", 1, None, at(1000))],
        [("z", 2, None, at(1001))],
    ]
    kind = "question_id string, step_i long, is_correct boolean, time timestamp"
    for i, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        found = spark.readStream.schema(kind).parquet(str(tmp_path / "in/*"))
        query = collapse_stream(found, late="10 minutes", idle_ms=30 * 60_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "question_id", "step_i") == [("a", 3, True, 3, False), ("a", 7, False, 1, False), ("b", 9, None, 2, False), ("c", 1, False, 2, False), ("d", 1, None, 2, True)]
