"""Preparing problem sets: unions, keep-first dedup, decontamination, numbering, splits."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which the texts of the substring test are broadcast, and of those in one automaton (some 60 times that in a worker).
BROADCAST_BYTES, AUTOMATON_BYTES = 32 << 20, 4 << 20
#: Characters of a piece of the substring test, and pieces of all texts up to which their hashes are broadcast.
PIECE = 32
BROADCAST_KEYS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder from spark.checkpoint.dir. Where that is unset, a local run (as in tests) makes one of its
    own; a cluster must set it."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}"))


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, below: int = 128 << 20) -> DataFrame:
    """df dealt to all cores if it comes from less than a split's bytes: a file of one row group is one task
    otherwise, which counts where each row takes long. Larger tables stay as they are scanned, without a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < below else df


def union_sources(sources: list[DataFrame], order: str = "row_idx") -> DataFrame:
    """All rows by name, missing columns null, with source_rank: the place of a row's source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)))


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in a total order, by a partial aggregate of one struct."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*(F.col(f"_row.{c}") if c in rest else F.col(c) for c in df.columns))


def first_non_null(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key, every column's first value that is not null."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest))


def drop_exact(df: DataFrame, evaluation: DataFrame, text: str = "problem", other: str = "text") -> DataFrame:
    """The rows whose text is not one of the evaluation's (a null text stays)."""
    return df.join(evaluation.select(F.col(other).alias(text)).distinct(), text, "left_anti").select(df.columns)


def drop_contained(df: DataFrame, evaluation: DataFrame, text: str = "problem", other: str = "text") -> DataFrame:
    """The rows whose text is contained in none of the evaluation's texts (null texts stay, empty ones go if there is
    an evaluation text).

    The rows' distinct texts, while they are of a checked, small size, become an automaton that each worker builds once and reads
    its evaluation texts through, each text once; texts of more than AUTOMATON_BYTES are dealt to ranges with a pass for each.
    Beyond BROADCAST_BYTES, rows and evaluation texts meet by equal pieces of PIECE characters: see contained_texts().
    """
    prompts = evaluation.select(F.col(f"`{other}`").cast("string").alias("_prompt")).where("_prompt is not null")
    texts = df.select(F.col(f"`{text}`").alias("_text")).where("_text is not null").distinct()
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if size <= BROADCAST_BYTES and find_spec("ahocorasick"):
        found = found_texts(texts, prompts, max(1, -(-size // AUTOMATON_BYTES)))
    else:
        found = contained_texts(texts, prompts.distinct())
    return df.join(found.select(F.col("_text").alias(text)), text, "left_anti").select(*(f"`{c}`" for c in df.columns))


#: The automaton that a worker process has built last, by what it is made of.
_automaton: dict[str, object] = {}


def _automaton_of(key: str, texts: list[str]):
    import ahocorasick

    if key not in _automaton:
        _automaton.clear()
        built = ahocorasick.Automaton()
        for text in texts:
            built.add_word(text, text)
        built.make_automaton()
        _automaton[key] = built
    return _automaton[key]


def found_texts(texts: DataFrame, prompts: DataFrame, ranges: int = 1) -> DataFrame:
    """The distinct texts (_text) that one of the prompts (_prompt) contains, by an Aho-Corasick automaton of the texts of
    each range of their hashes. The texts, a checked number of characters, are broadcast; prompts are neither moved nor joined."""
    spark, out = prompts.sparkSession, texts.where((F.col("_text") == "") & F.lit(not prompts.isEmpty()))  # the empty text is in any prompt
    for r in range(ranges):
        own = texts.where((F.col("_text") != "") & (F.pmod(F.xxhash64("_text"), F.lit(ranges)) == r))
        shared, key = spark.sparkContext.broadcast(own.toArrow().column(0).to_pylist()), uuid.uuid4().hex

        def find(batches, shared=shared, key=key):
            if not shared.value:
                return
            automaton, met = _automaton_of(key, shared.value), set()
            for batch in batches:
                new = {text for prompt in batch.column(0).to_pylist() for _, text in automaton.iter(prompt)} - met
                met |= new
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], ["_text"])

        out = out.unionAll(prompts.mapInArrow(find, "_text string"))
    return out.distinct()


def contained_texts(texts: DataFrame, prompts: DataFrame) -> DataFrame:
    """The distinct texts (_text) that one of the distinct prompts (_prompt) contains.

    Each place of a prompt gives the hash of the PIECE characters from there, with a number for the prompt and not the
    prompt itself. A text is cut into such pieces, the last one flush with its end; if prompts have them all, it is held
    against the prompts that have its rarest one, so that a common opening brings few together. Shorter texts are looked
    for whole, by length.
    """
    asked = prompts.select(F.xxhash64("_prompt").alias("_pid"), "_prompt")
    places = F.sequence(F.lit(1), F.greatest(F.char_length("_prompt") - PIECE + 1, F.lit(1)))
    keys = asked.select("_pid", F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substr("_prompt", i, F.lit(PIECE)))))).alias("_key"))
    n = F.char_length("_text")
    starts = F.array_union(F.sequence(F.lit(1), n - PIECE + 1, F.lit(PIECE)), F.array(n - PIECE + 1))
    long = texts.where(n >= PIECE).select(F.xxhash64("_text").alias("_tid"), "_text")
    cut_up = long.select("_tid", F.explode(F.transform(starts, lambda i: F.xxhash64(F.substr("_text", i, F.lit(PIECE))))).alias("_key"))
    wanted = cut_up.select("_key").distinct()
    if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        # only places where a piece of a text could start leave their task
        keys = keys.join(F.broadcast(wanted), "_key", "left_semi")
    counts = keys.groupBy("_key").agg(F.count("*").alias("_n"))
    rarest = cut_up.join(counts, "_key", "left").groupBy("_tid").agg(F.min_by("_key", F.struct("_n", "_key")).alias("_key"), F.count_if(F.col("_n").isNull()).alias("_lacks"))
    pairs = rarest.where("_lacks = 0").join(keys, "_key").select("_tid", "_pid").distinct()
    far = pairs.join(long, "_tid").join(asked, "_pid").where(F.col("_prompt").contains(F.col("_text"))).select("_text")
    lengths = [r[0] for r in texts.where((n < PIECE) & (n > 0)).select(n).distinct().collect()]  # at most PIECE - 1 numbers
    out = far.unionAll(texts.where((n == 0) & F.lit(not prompts.isEmpty())))  # the empty text is in any prompt
    for k in lengths:
        parts = F.transform(F.sequence(F.lit(1), F.char_length("_prompt") - k + 1), lambda i: F.substr("_prompt", i, F.lit(k)))  # noqa: B023
        pieces = asked.where(F.char_length("_prompt") >= k).select(F.explode(F.array_distinct(parts)).alias("_text")).distinct()
        out = out.unionAll(texts.where(n == k).join(pieces, "_text", "left_semi"))
    return out.distinct()


def shared_texts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Texts of both one-column tables, once each."""
    return a.intersect(b)


def missing_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys of a that b lacks, once each."""
    return a.select(*keys).subtract(b.select(*keys))


def missing_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids from 0 to one below the number of rows that df lacks."""
    n = df.count()
    return df.sparkSession.range(n).select(F.col("id").alias(id_col)).join(df.select(id_col), id_col, "left_anti")


def first_half(df: DataFrame, position: str = "row_idx") -> DataFrame:
    """The rows in the first half of the positions 0 to n - 1, the middle one of an odd number left out."""
    return df.where(F.col(position) < df.count() // 2)


def drop_columns_like(df: DataFrame, part: str = "bin") -> DataFrame:
    """df without the columns whose names contain a text."""
    return df.select(*(c for c in df.columns if part not in c))


def known_level(df: DataFrame, level: str = "level") -> DataFrame:
    """The rows whose level is not "?" (null stays)."""
    return df.where(~F.col(level).eqNullSafe("?"))


def split_by_pattern(df: DataFrame, column: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The rows that match, in any case of letters, and all others (null among them)."""
    hit = F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))
    return df.where(hit), df.where(~hit)


def hash_split(df: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(held out, rest) by the key's hash; reruns agree."""
    out = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(out), df.where(~out)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df in a pseudorandom order that reruns share."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def fixed_order(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """df in the order in which the values are given, others last."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0).cast("bigint"))
    return df.orderBy(place.asc_nulls_last(), column)


def expand_budgets(problems: DataFrame, budgets: list[int]) -> DataFrame:
    """Each problem with each budget, and unique_id."""
    grid = F.explode(F.array(*map(F.lit, budgets))).alias("target_think_tokens")
    return problems.select("*", F.concat_ws("-", F.col("id").cast("string"), "dataset").alias("unique_id"), grid)


def unpivot_counts(df: DataFrame, columns: list[str], count) -> DataFrame:
    """(column, n): an aggregate of each column as a row."""
    one = df.agg(*(count(c).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "n")


def is_one_of(column: str, values: list[str]) -> Column:
    return F.col(column).isin(values)
