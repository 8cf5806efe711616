"""The logical tables and their types."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "floats": T.ArrayType(T.FloatType())}


def _table(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(":") for c in columns.split())])


PROBLEMS = _table("row_idx:long id:long dataset:string problem:string solution:string level:string")
BUDGET_GRID = _table("target_think_tokens:int")
EXPANDED = _table("id:long unique_id:string dataset:string level:string problem:string solution:string target_think_tokens:int")
GENERATIONS = _table("unique_id:string prompt:string solution:string generated:string expected_value:string generated_value:string token_count:long is_correct:boolean latency_sec:double")
REGRESSOR_RUNS = _table("question_id:string prompt:string solution:string generated_think_text:string generated_text:string target_think_tokens:int generated_think_tokens:int latency_sec:double is_correct:boolean")
TRAIN_TARGETS_HIDDEN = _table("question_id:string prompt:string target_think_tokens:int generated_think_tokens:int is_correct:boolean level:int hidden:floats")
TARGET_TOKENS = _table("id:long target:int")
STATIC_RUNS = _table("question_id:string problem:string generated_text:string actual_tokens:long is_correct:boolean")
DYNAMIC_RUNS = _table("question_id:string problem:string generated_text:string actual_tokens:long is_correct:boolean step_i:int target_tokens:int")
OTHER_RESULTS = _table("question_id:string level:string actual_tokens:long is_correct:boolean method:string")
COMPARISON = _table("question_id:string level:int actual_tokens:long is_correct:boolean method:string")
SUMMARY = _table("model:string dataset:string accuracy:double num_correct:long num_total:long avg_tokens:double avg_tokens_clean:double num_hallucinations:long")
HIDDEN_STATES = _table("dataset:string id:long hidden_states:floats")
MODEL = T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("w", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("b", T.ArrayType(T.DoubleType()))])
