"""Whole runs, from tables to tables: building problem sets, generating data, choosing budgets, evaluating, reporting.

Each is one declarative plan with a model provider in the middle where a model has its say; nothing runs on the
driver row by row, and data sets are handled in one job, not in a loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions import answers as A
from tokenledger.functions import text as X
from tokenledger.functions import vectors as V
from tokenledger.operators import joins, labels, metrics, network, prep, providers
from tokenledger.sources import tables

MODES = ("baseline", "nowait", "regressor", "sentence", "tale")


@dataclass(frozen=True)
class Source:
    """A raw table of problems: the data set it becomes, and its columns."""

    dataset: str
    problem: str
    solution: str
    level: str | None = None


#: The raw tables and their columns; the first two are for training, the rest for evaluation.
SOURCES = (
    Source("aime", "Question", "Answer"),
    Source("math", "problem", "solution", "level"),
    Source("math-500", "problem", "solution", "level"),
    Source("gsm8k", "question", "answer"),
    Source("olympiad", "question", "final_answer"),
    Source("amc", "question", "answer"),
    Source("aime-250", "prompt", "solution_col"),
)
TRAINING = ("aime", "math")


def load_split(spark: SparkSession, root: str, name: str, split: str = "test", config: str | None = None) -> DataFrame:
    """A split of a data set from a local mirror: <root>/<name>[/<config>]/<split>.parquet."""
    return spark.read.parquet("/".join(x for x in (root, name, config, f"{split}.parquet") if x))


def as_problems(raw: DataFrame, source: Source, order: str) -> DataFrame:
    """A raw table as problems, all texts; order is the column that its rows are in order of."""
    kinds = dict(raw.dtypes)
    level = X.level_text(F.col(source.level).cast("string")) if source.level else F.lit(None).cast("string")
    return raw.select(F.col(order).alias("row_idx"), F.lit(source.dataset).alias("dataset"), F.col(source.problem).cast("string").alias("problem"), X.solution_text(F.col(source.solution), kinds[source.solution]).alias("solution"), level.alias("level"))


def problem_set(raw: dict[str, DataFrame], order: str = "row_idx", sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """All sources as one table: each problem once, where it comes first, without unknown levels, numbered from 0."""
    parts = [as_problems(raw[s.dataset], s, order) for s in sources if s.dataset in raw]
    first = prep.keep_first(prep.union_sources(parts), ["problem"], "source_rank", "row_idx")
    kept = tables.with_position(prep.known_level(first), "source_rank", "row_idx", name="id")
    return kept.select("id", "dataset", "problem", "solution", "level")


def train_and_eval(problems: DataFrame, training: tuple[str, ...] = TRAINING) -> tuple[DataFrame, DataFrame]:
    """(training, evaluation): the first without problems that a text of the second contains."""
    evaluation = problems.where(~F.col("dataset").isin(*training))
    return prep.drop_contained(problems.where(F.col("dataset").isin(*training)), evaluation, other="problem"), evaluation


def score(rows: DataFrame, profile: str = "pipeline") -> DataFrame:
    """rows with expected_value, generated_value and is_correct."""
    return rows.withColumn("_e", A.evaluate(F.col("solution"), F.col("generated"), profile)).select(*rows.columns, "_e.expected_value", "_e.generated_value", "_e.is_correct")


_GENERATIONS = ("unique_id", "prompt", "solution", "generated", "expected_value", "generated_value", "token_count", "is_correct", "latency_sec")


def generation_work(problems: DataFrame, budgets: list[int] = V.BUDGETS, method: str = "token", template: str = "{}") -> DataFrame:
    """The first half of the problems with every budget and its prompt."""
    work = prep.expand_budgets(prep.first_half(problems.withColumn("row_idx", F.col("id"))), budgets)
    content = X.problem_prompt(F.col("problem"), F.col("dataset"), X.INSTRUCTION_CURLY)
    prompt = X.budget_prompt(content, F.col("target_think_tokens"), method, X.SENTENCE_GENERATION)
    return work.withColumn("prompt", X.chat_prompt(prompt, template)).drop("row_idx")


def generate_training_data(problems: DataFrame, make, path: str, budgets: list[int] = V.BUDGETS, method: str = "token", batches: int = 1, count=providers.stub_token_count) -> DataFrame:
    """Generated and scored rows of all budgets at path; a run that was stopped goes on where it is missing rows."""

    def stage(work: DataFrame) -> DataFrame:
        made = score(providers.generated(work, make).withColumn("token_count", count(F.col("generated")).cast("long")))
        return made.select(*_GENERATIONS, "target_think_tokens", "dataset", "level")

    return tables.run_resumable(generation_work(problems, budgets, method), stage, path, "unique_id", "target_think_tokens", batches=batches)


def predict_budgets(problems: DataFrame, embed, layers: list[tuple], bins: list[int] = V.BUDGETS, threshold: float = 0.8, too_hard: str = "likeliest") -> DataFrame:
    """(id, target, too_hard): a budget for each problem, by a network over its text's vector."""
    once = prep.keep_first(problems.select("id", "problem", F.col("problem").alias("_order")), ["id"], "_order").drop("_order")
    scored = network.logits(providers.embedded(once, embed, "problem"), layers, "hidden")
    return scored.select("id", V.choose_budget(network.probabilities(F.col("logits")), bins, threshold, too_hard).alias("c")).select("id", F.col("c.budget").alias("target"), "c.too_hard")


def estimate_budgets(problems: DataFrame, make, default: int = 100) -> DataFrame:
    """(id, target): a budget that the model states itself."""
    asked = problems.select("id", X.estimate_prompt(F.col("problem")).alias("prompt"))
    return providers.generated(asked, make, name="estimate").select("id", X.stated_budget(F.col("estimate"), default).cast("int").alias("target"))


def evaluate(problems: DataFrame, mode: str, make, datasets: list[str], targets: DataFrame | None = None, template: str = "{}", count=providers.stub_token_count) -> DataFrame:
    """Generated and scored rows of the data sets in a mode. Modes with budgets take them from targets (id, target);
    in mode "tale", without targets, the model states them. A problem without a budget is an error."""
    if mode not in MODES:
        raise ValueError(f"the mode {mode} is none of {', '.join(MODES)}")
    work = problems.where(F.col("dataset").isin(*datasets)).withColumn("unique_id", X.pair_key(F.col("id"), F.col("dataset")))
    if mode in ("regressor", "sentence", "tale"):
        if targets is None:
            if mode != "tale":
                raise ValueError(f"the mode {mode} needs targets")
            targets = estimate_budgets(work, make)
        work = joins.strict_lookup(work, targets.withColumn("_at", F.lit(0)), "id", "target", "_at")
    content = X.problem_prompt(F.col("problem"), F.col("dataset"))
    work = work.withColumn("prompt", X.chat_prompt(X.budget_prompt(content, F.col("target"), mode) if "target" in work.columns else content, template))
    made = providers.generated(work, make).withColumn("token_count", count(F.col("generated")).cast("long"))
    return score(made).select(*_GENERATIONS, "dataset")


def suppressed_ids(vocabulary: DataFrame, bias: float = -100.0) -> DataFrame:
    """(token_id, bias) of the tokens with second thoughts in a vocabulary of (token_id, token)."""
    return vocabulary.where(X.has_second_thought(F.col("token"))).select("token_id", F.lit(bias).alias("bias"))


def results_report(runs: dict[str, DataFrame], datasets: list[str], profile: str = "analysis") -> tuple[DataFrame, DataFrame]:
    """(summary, report) of the generated rows of each model, scored anew: a row a model and data set, and a row a
    model with three measures of each data set."""
    parts = None
    for model, df in runs.items():
        part = df.select(F.lit(model).alias("model"), "dataset", "solution", "generated", "token_count")
        parts = part if parts is None else parts.unionByName(part)
    scored = score(parts, profile).withColumn("hallucinated", X.long_answer(F.col("generated_value")))
    summary = metrics.model_dataset_summary(scored, "model", "dataset")
    return summary, prep.fixed_order(metrics.report(summary, datasets, ["accuracy", "avg_tokens", "avg_tokens_clean"]), "model", list(runs))


def training_matrix(runs: DataFrame, bins: list[int] = V.BUDGETS, vector: str = "hidden") -> DataFrame:
    """(question_id, hidden, y) of runs with vectors: the first row's vector and the labels of all bins, in one pass."""
    x = runs.groupBy("question_id").agg(F.min_by(vector, "row_idx").alias(vector))
    return labels.label_matrix(runs, bins).join(x, "question_id")


def compare_methods(static: DataFrame, dynamic: DataFrame, questions: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(comparison, curve, fits): runs of all methods, accuracy and tokens of each method and level, and a parabola of
    the accuracy over levels. Runs of level 6 are judged anew by the older algorithm."""
    recheck = A.legacy_correct(F.col("solution"), F.col("generated_text"))
    all_runs = labels.comparison(static, dynamic, questions, others, 6, recheck)
    curve = metrics.level_curve(all_runs, "method", "level")
    return all_runs, curve, metrics.quadratic_fit(curve, "level", "accuracy", "method")
