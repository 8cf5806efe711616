"""Whole runs with stub models."""

import numpy as np
import pytest

from tokenledger.operators import network, providers
from tokenledger.plans import lifecycle as L


@pytest.fixture(scope="module")
def raw(spark):
    return {
        "aime": spark.createDataFrame([(0, "What is 1+1?", 2), (1, "Same text", 5)], "row_idx int, Question string, Answer int"),
        "math": spark.createDataFrame([(0, "Same text", "x", "Level 3"), (1, "Odd", "y", "Level ?"), (2, "Half of 4", r"\boxed{2}", "Level 1"), (3, "inside", "z", None)], "row_idx int, problem string, solution string, level string"),
        "math-500": spark.createDataFrame([(0, "Goes inside out", "3", 4)], "row_idx int, problem string, solution string, level int"),
        "olympiad": spark.createDataFrame([(0, "Two answers", ["1", "2"])], "row_idx int, question string, final_answer array<string>"),
        "aime-250": spark.createDataFrame([(0, "Own prompt", "7")], "row_idx int, prompt string, solution_col string"),
    }


@pytest.fixture(scope="module")
def problems(raw):
    return L.problem_set(raw).cache()


def test_problem_set(problems):
    got = [tuple(r) for r in problems.orderBy("id").collect()]
    assert got == [
        (0, "aime", "What is 1+1?", "2", None), (1, "aime", "Same text", "5", None), (2, "math", "Half of 4", r"\boxed{2}", "1"), (3, "math", "inside", "z", None),
        (4, "math-500", "Goes inside out", "3", "4"), (5, "olympiad", "Two answers", "1\n2", None), (6, "aime-250", "Own prompt", "7", None),
    ]
    train, evaluation = L.train_and_eval(problems)
    assert [r["id"] for r in train.orderBy("id").collect()] == [0, 1, 2] and evaluation.count() == 3


def test_generation(problems, tmp_path):
    calls = lambda: providers.stub_generate
    out = L.generate_training_data(problems, calls, str(tmp_path / "g"), [100, 357])
    assert out.count() == 6 and set(out.columns) >= {"unique_id", "prompt", "is_correct", "target_think_tokens"}
    assert L.generate_training_data(problems, calls, str(tmp_path / "g"), [100, 357]).count() == 6
    prompt = out.where("unique_id = '0-aime' and target_think_tokens = 357").first()["prompt"]
    assert prompt == "What is 1+1?\nLet’s think step by step and output the final answer within boxed{}. Think for 357 tokens."


def test_budgets_and_evaluation(spark, problems):
    layers = network.init_network((8, 4, 20))
    targets = L.predict_budgets(problems, lambda: providers.stub_embed(8), layers)
    assert targets.count() == 7 and targets.where("target is null").count() == 0
    calls = lambda: providers.stub_generate
    for mode in L.MODES:
        out = L.evaluate(problems, mode, calls, ["math-500", "aime-250"], None if mode == "tale" else targets)
        assert out.count() == 2 and out.where("generated_value is null").count() == 0
    assert "Use less than 100 tokens." in L.evaluate(problems, "tale", calls, ["aime-250"]).first()["prompt"]
    assert L.evaluate(problems, "baseline", calls, ["aime-250"]).first()["prompt"] == "Own prompt"
    with pytest.raises(ValueError):
        L.evaluate(problems, "regressor", calls, ["aime-250"])
    with pytest.raises(ValueError):
        L.evaluate(problems, "other", calls, ["aime-250"])
    with pytest.raises(Exception, match="no target for id 6"):
        L.evaluate(problems, "regressor", calls, ["aime-250"], targets.where("id <> 6")).collect()
    summary, report = L.results_report({"m": L.evaluate(problems, "nowait", calls, ["math-500", "aime-250"])}, ["math-500", "aime-250"])
    assert summary.count() == 2 and report.columns[:3] == ["model", "accuracy__math-500", "accuracy__aime-250"]
    words = spark.createDataFrame([(1, " Wait"), (2, "cat"), (3, "now")], "token_id int, token string")
    assert [r["token_id"] for r in L.suppressed_ids(words).orderBy("token_id").collect()] == [1, 3]


def test_training_matrix(spark):
    runs = spark.createDataFrame([("q", 100, True, 0, [1.0]), ("q", 357, False, 1, [2.0])], "question_id string, target_think_tokens int, is_correct boolean, row_idx int, hidden array<float>")
    assert tuple(L.training_matrix(runs, [100, 357]).first()) == ("q", [1, 0], [1.0])


def test_comparison(spark):
    s = "question_id string, problem string, generated_text string, actual_tokens long, is_correct boolean"
    static = spark.createDataFrame([(f"q{i}", "p", rf"\boxed{{{i}}}", 10 * i, None) for i in range(4)], s)
    dynamic = spark.createDataFrame([(f"q{i}", "p", "t", 5 * i, i % 2 == 0, k) for i in range(4) for k in (0, 1)], s + ", step_i int")
    questions = spark.createDataFrame([(f"q{i}", 3 + i, r"\boxed{3}") for i in range(4)], "question_id string, level int, solution string")
    others = spark.createDataFrame([("q0", 3, 1, True, "other")], "question_id string, level int, actual_tokens long, is_correct boolean, method string")
    runs, curve, fits = L.compare_methods(static, dynamic, questions, others)
    assert runs.count() == 9 and runs.where("is_correct is null").count() == 0
    got = {(r["method"], r["level"]): r["accuracy"] for r in curve.collect()}
    assert got["static", 6] == 1.0 and got["static", 3] == 0.0 and got["dynamic", 3] == 1.0 and got["dynamic", 6] == 0.0
    assert np.isfinite(next(r["c2"] for r in fits.collect() if r["method"] == "dynamic"))
