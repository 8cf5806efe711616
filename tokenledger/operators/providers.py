"""The boundary to models: a stage from rows to rows, whatever makes the texts or vectors."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Generate = Callable[[list[str]], list[str | None]]
Embed = Callable[[list[str]], np.ndarray]


def stub_generate(prompts: list[str]) -> list[str | None]:
    """A stand-in for a model: a boxed number that depends on the prompt alone."""
    return [f"<think>{p[:20]}</think> \\boxed{{{int(hashlib.sha256(p.encode()).hexdigest()[:6], 16) % 100}}}" for p in prompts]


def stub_embed(size: int) -> Embed:
    """A stand-in for hidden states: numbers that depend on the text alone, rounded to 16 bits."""

    def run(texts: list[str]) -> np.ndarray:
        digest = lambda t: b"".join(hashlib.sha256(f"{k}:{t}".encode()).digest() for k in range(-(-size // 32)))
        rows = [np.frombuffer(digest(t), np.uint8, size) / 255 - 0.5 for t in texts]
        return np.array(rows, np.float16).astype(np.float32).reshape(len(texts), size)

    return run


def generated(df: DataFrame, make: Callable[[], Generate], prompt: str = "prompt", name: str = "generated", batch: int = 100) -> DataFrame:
    """df with a generated text and latency_sec, the time of a batch over its rows. make() loads the model, once a
    task; rows in are rows out. logit biases and limits are the generator's own matter."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in df.schema.fields if f.name not in (name, "latency_sec")), T.StructField(name, T.StringType()), T.StructField("latency_sec", T.DoubleType())])

    def run(batches):
        model = make()
        for rows in batches:
            for k in range(0, len(rows), batch):
                part = rows.iloc[k : k + batch].copy()
                began = time.perf_counter()
                part[name] = model([p or "" for p in part[prompt]])
                part["latency_sec"] = (time.perf_counter() - began) / max(1, len(part))
                yield part[schema.names]

    return df.mapInPandas(run, schema)


def embedded(df: DataFrame, make: Callable[[], Embed], text: str = "prompt", name: str = "hidden", batch: int = 8) -> DataFrame:
    """df with a vector of each text, computed once for each distinct one."""
    from .joins import once_per_text

    def stage(texts: DataFrame) -> DataFrame:
        kind = texts.schema[text].dataType.simpleString()

        def run(batches):
            model = make()
            for rows in batches:
                for k in range(0, len(rows), batch):
                    part = rows[text].iloc[k : k + batch]
                    yield pd.DataFrame({text: part.to_numpy(), name: list(model(list(part)))})

        return texts.mapInPandas(run, f"{text} {kind}, {name} array<float>")

    return once_per_text(df, text, stage)


def stub_token_count(text: Column) -> Column:
    """A stand-in for a tokenizer: words."""
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(text), r"\s+")))
