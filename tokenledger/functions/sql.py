"""Text and vector functions for SQL text.

Functions of built-in expressions become temporary SQL functions, which the planner writes out as if they stood in the query:
plain ones as the analyzer writes them, written rules (normalized answers and verdicts among them) by their own text. The scan
for answers and the symbolic comparison are Arrow functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import answers as A
from . import text as X
from . import vectors as V
from .symbolic import symbolic_equal

#: Name -> (parameters, the function of their columns).
NATIVE = {
    "boxed_first": ("s STRING", X.boxed_first),
    "marked_answer": ("s STRING", X.marked_answer),
    "last_dollars": ("s STRING", X.last_dollars),
    "lone_number": ("s STRING", X.lone_number),
    "think_text": ("s STRING", X.think_text),
    "think_span": ("s STRING", X.think_span),
    "stated_budget": ("s STRING", X.stated_budget),
    "prompt_budget": ("s STRING", X.prompt_budget),
    "id_part": ("s STRING", X.id_part),
    "level_text": ("s STRING", X.level_text),
    "level_number": ("s STRING", X.level_number),
    "parse_flag": ("s STRING", X.parse_flag),
    "has_second_thought": ("s STRING", X.has_second_thought),
    "long_answer": ("s STRING", X.long_answer),
    "pair_key": ("a STRING, b STRING", X.pair_key),
    "run_name": ("path STRING, mode STRING", X.run_name),
    "sigmoid": ("x DOUBLE", V.sigmoid),
    "sigmoid_loss": ("logit DOUBLE, y DOUBLE", V.sigmoid_loss),
    "first_correct_class": ("y ARRAY<INT>", V.first_correct_class),
    "stops": ("actual BIGINT, target BIGINT, tolerance BIGINT, ended BOOLEAN", V.stops),
}


#: Name -> (parameters, a written rule, its options).
WRITTEN = {
    "boxed_balanced": ("s STRING", X.boxed_balanced_native, ()),
    "extract_answer": ("s STRING", X._native_answer, ("analysis",)),
    "extract_answer_pipeline": ("s STRING", X._native_answer, ("pipeline",)),
    "normalize_answer": ("s STRING", A.normalize_answer, ()),
    "normalize_answer_strict": ("s STRING", A.normalize_answer, ("analysis", True)),
    "answer_set": ("s STRING", A.answer_set, ()),
    "number_value": ("s STRING", A.number_value, ()),
    "equivalent": ("a STRING, b STRING", A._equivalent, ("analysis", False)),
    "judge_answers": ("a STRING, b STRING", A._verdict, ("analysis",)),
    "legacy_form": ("s STRING", A.legacy_form, ()),
    "legacy_correct": ("a STRING, b STRING", A.legacy_correct, ()),
}


def register(spark: SparkSession) -> None:
    """All of NATIVE and WRITTEN, balanced_box, scan_answer, symbolic_equal and evaluate (of two texts, a struct as evaluate() gives
    it) as functions of SQL."""
    spark.udf.register("balanced_box", X._balanced)
    spark.udf.register("scan_answer", X._SCANNERS["analysis"])
    spark.udf.register("symbolic_equal", symbolic_equal)
    for name, (parameters, make) in NATIVE.items():
        names, kinds = zip(*(p.split(" ", 1) for p in parameters.split(", ")))
        row = spark.range(1).select(*(F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds)))
        body = row.select(make(*map(F.col, names)).alias("x"))._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    for name, (parameters, rule, options) in WRITTEN.items():
        names = [p.split(" ")[0] for p in parameters.split(", ")]
        value = names[0] if len(names) == 1 else "named_struct(" + ", ".join(f"'c{i}', {n}" for i, n in enumerate(names)) + ")"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN transform(array({value}), {rule.text(options, ())})[0]")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION evaluate(expected STRING, generated STRING) RETURN judge_answers(extract_answer(expected), extract_answer(generated))")
