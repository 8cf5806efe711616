"""Mixing sources to target weights, by DataFrame operations only.

Each source is one stream of words: its documents in the order of a hash of id and text, an order that depends on
nothing else, packed into blocks of a fixed number of words (the last may be shorter). A source's target decides how many
slots it fills in all. A seeded draw deals these to the output shards: each shard's counts of the sources are
multinomial, with the sources' totals held, so that every source meets its target. A shard then holds the next slots of
each source, as many as it drew; slot i of a pass over a source holds block permutation(i), a seeded pseudorandom
permutation of the source's whole blocks, so a pass takes every block once before any is taken again; slots and blocks
are joined by index. Another seed gives another mix.

Positions are two-level prefix sums over buckets, so no task holds a source's documents or shards; slots are made in runs
of bounded length, in a number of tasks that grows with them. Only sources themselves, one row each, are in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, unused

#: Weights of the sources in their order, repeated.
WEIGHTS = (5, 2, 1)
#: A source gives each of its words at most so many times.
MOST_PASSES = 3
BLOCK_WORDS = 64
#: Words of a shard on average; slots that one row is expanded to at most, slots of a task, rows of a bucket on average.
SHARD_WORDS = 1 << 20
RUN_SLOTS = 4096
TASK_SLOTS = 1 << 17
BUCKET_ROWS = 2048
#: Shards whose counts are summed up together.
SHARD_GROUP = 4096
#: Rounds of the swap-or-not shuffle.
ROUNDS = 24


def permutation(i: Column, n: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0 .. n - 1, picked by key, takes i: the swap-or-not shuffle (Hoang, Morris and
    Rogaway, 2012). In each round the key pairs all numbers, x with k - x modulo n, and tosses a coin for every pair
    whether it swaps. Exact for any n > 0."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(x, partner)), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, turn)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_no, source_size, target): one row a source, given (source, size) rows.

    source_no counts from 0 in order of code points, null last. Shares of all words go by weight; no target
    exceeds MOST_PASSES times its source's size; what is over goes to the others by weight. In order of
    size by weight, the sources held at their limit come first, so one pass over running sums finds them. That pass
    is one task's: it has one row for each source, whatever the number of documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    numbered = by_source.withColumn("source_no", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", F.element_at(weights, (F.col("source_no") % len(WEIGHTS)).cast("int") + 1))
    room = (F.col("source_size") * MOST_PASSES).cast("double") / F.col("weight")
    filled = Window.orderBy("room", "source_no")
    upto, every = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - MOST_PASSES * F.coalesce(F.sum("source_size").over(upto), F.lit(0))).cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    # a source that its level doesn't fill ends the run of those at their limit; its level holds from there on
    leveled = numbered.withColumn("room", room).withColumn("level", level).withColumn("rest", F.min(F.when(F.col("room") > F.col("level"), F.struct("room", "source_no", "level"))).over(every)["level"])
    target = F.least((F.col("source_size") * MOST_PASSES).cast("double"), F.coalesce(F.col("rest") * F.col("weight"), (F.col("source_size") * MOST_PASSES).cast("double")))
    return leveled.select("source", "source_no", "source_size", target.alias("target"))


def placed(sizes: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """sizes (id, source, size, key) with source_no, source_size, target, start (the row's first word in its source's
    stream), bucket and place (the row's number in its bucket, which tells repeated rows apart)."""
    digits = 1
    while rows > BUCKET_ROWS * 16**digits and digits < 8:
        digits += 1
    keyed = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    sums = keyed.groupBy("source_no", "bucket").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_no", "bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("key", "id", "size")
    start = F.col("_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.join(sums, ["source_no", "bucket"]).withColumn("start", start).withColumn("place", F.row_number().over(inside)).drop("_before")


def source_plan(targets: DataFrame) -> DataFrame:
    """targets, for sources with words, with take (words it gives), blocks, whole (blocks that aren't shorter), passes
    (over all of it), rest (words of the last pass) and slots."""
    size = F.col("source_size")
    plan = targets.where("source_size > 0").withColumn("take", F.least(F.floor(F.col("target") + 0.5), size * MOST_PASSES))
    plan = plan.withColumns({"blocks": F.ceil(size / BLOCK_WORDS), "whole": F.floor(size / BLOCK_WORDS), "passes": F.floor(F.col("take") / size)})
    plan = plan.withColumn("rest", F.col("take") - F.col("passes") * size)
    return plan.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK_WORDS)).where("slots > 0")


def _tasks(df: DataFrame, words: int, *by: str) -> DataFrame:
    """df dealt to a number of tasks that grows with the slots it will be expanded to, and that stays as it is."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-MOST_PASSES * words // (BLOCK_WORDS * TASK_SLOTS)))
    return df.repartition(n, *by)


def draw_counts(plan: DataFrame, words: int, seed: int) -> DataFrame:
    """The draw: (source_no, shard, drawn, first), a row for each source that a shard has slots of. Every slot falls to
    one of ceil(words / SHARD_WORDS) shards by a seeded hash, which makes the counts multinomial; first is the number
    of the source's slots in the shards before."""
    shards = max(1, -(-words // SHARD_WORDS))
    runs = plan.select("source_no", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN_SLOTS))).alias("run"))
    slots = _tasks(runs, words, "source_no", "run").select("source_no", F.explode(F.sequence(F.col("run") * RUN_SLOTS, F.least((F.col("run") + 1) * RUN_SLOTS, F.col("slots")) - 1)).alias("slot"))
    counts = slots.groupBy("source_no", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "source_no", "slot"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("drawn"))
    counts = cut(counts.withColumn("group", F.floor(F.col("shard") / SHARD_GROUP)))
    before = lambda by, order: F.coalesce(F.sum("drawn").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("source_no", "group").agg(F.sum("drawn").alias("drawn"))
    groups = groups.select("source_no", "group", before(["source_no"], "group").alias("_before"))
    return counts.join(groups, ["source_no", "group"]).select("source_no", "shard", "drawn", (F.col("_before") + before(["source_no", "group"], "shard")).alias("first"))


def draw_slots(targets: DataFrame, words: int, seed: int = 0) -> DataFrame:
    """The mix: (source_no, slot, pass, block, words, shard), one row a slot; words is how many of the block's are taken.

    The words of a source's slots add up to its target, rounded. A source's last, shorter block comes last in a pass.
    """
    plan = source_plan(targets)
    runs = draw_counts(plan, words, seed).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("drawn") - 1) / RUN_SLOTS))))
    runs = runs.join(plan.select("source_no", "source_size", "blocks", "whole", "passes", "rest"), "source_no")
    upto = F.least((F.col("run") + 1) * RUN_SLOTS, F.col("drawn"))
    slots = _tasks(runs, words, "source_no", "shard", "run").withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("run") * RUN_SLOTS, F.col("first") + upto - 1)))
    slots = slots.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("_i", F.pmod("slot", "blocks"))
    placed_at = permutation(F.col("_i"), F.greatest(F.col("whole"), F.lit(1)), F.lit(seed), F.col("source_no"), F.col("pass"))
    slots = slots.withColumn("block", F.when(F.col("_i") < F.col("whole"), placed_at).otherwise(F.col("_i")))
    full = F.least(F.lit(BLOCK_WORDS), F.col("source_size") - F.col("block") * BLOCK_WORDS)
    taken = F.when(F.col("pass") < F.col("passes"), full).otherwise(F.least(full, F.col("rest") - F.col("_i") * BLOCK_WORDS))
    return slots.select("source_no", "slot", F.col("pass").cast("int").alias("pass"), "block", taken.cast("long").alias("words"), "shard")


def block_pieces(rows: DataFrame) -> DataFrame:
    """rows of placed() with block, and the words [lo, hi) of the block that are theirs; none for empty rows."""
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    at = F.col("block") * BLOCK_WORDS
    pieces = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    return pieces.withColumn("lo", F.greatest(F.col("start") - at, F.lit(0))).withColumn("hi", F.least(F.col("start") + F.col("size") - at, F.lit(BLOCK_WORDS)))


def _key(id_col: str, text_col: str) -> Column:
    """A row's place in its source's stream: a hash of its id and text, so that neither null nor repeated ids go together."""
    return F.md5(F.concat_ws("~", F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string")))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _key(id_col, text_col).alias("key"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int):
    """(sizes, their rows, targets, slots)"""
    sizes = cut(_sized(docs, id_col, text_col, source_col))
    rows, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = cut(source_targets(sizes))
    return sizes, rows, targets, draw_slots(targets, words, seed)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, slots). documents: (id, source, size, source_size, target, taken) and the row's place in its
    source's stream, one row a row of docs, without its other columns; slots: see draw_slots().

    A null text has no words, and a null source is a source. A null id is an id like any other. Repeated rows are
    separate rows. Texts may be of any length. Without any word, all targets are 0. An empty table gives none. The same
    seed gives the same mix.
    """
    sizes, rows, targets, slots = _planned(docs, id_col, text_col, source_col, seed)
    full = F.col("words") == F.least(F.lit(BLOCK_WORDS), F.col("source_size") - F.col("block") * BLOCK_WORDS)
    drawn = slots.join(F.broadcast(targets.select("source_no", "source_size")) if targets.count() <= 10_000 else targets.select("source_no", "source_size"), "source_no")
    drawn = drawn.groupBy("source_no", "block").agg(F.count_if(full).alias("times"), F.coalesce(F.max(F.when(~full, F.col("words"))), F.lit(0)).alias("part"))
    pieces = block_pieces(placed(sizes, targets, rows)).join(drawn, ["source_no", "block"], "left")
    width = F.col("hi") - F.col("lo")
    taken = F.coalesce(F.col("times") * width + F.greatest(F.least(F.col("hi"), F.col("part")) - F.col("lo"), F.lit(0)), F.lit(0))
    keys = ["id", "source", "size", "source_no", "source_size", "target", "start", "key", "bucket", "place"]
    return pieces.groupBy(*keys).agg(F.sum(taken).alias("taken")), slots


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str | None = "n_chars", seed: int = 0) -> DataFrame:
    """The mix as rows of docs: a document comes once for each full pass over its source and, where the last pass
    took some of its words, once more with those (all of them: the text as it is; else joined by one space).

    count_col, where given, is the text's length again. Documents of which nothing is taken, empty ones included, do not
    come. All other columns stay as they are, whatever their names. Nulls and empty tables are as in mix_plan().
    """
    sizes, rows, targets, slots = _planned(docs, id_col, text_col, source_col, seed)
    passes = F.floor(F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * MOST_PASSES) / F.greatest("source_size", F.lit(1)))
    # places and spans, short rows, are cut: in one plan, with places in it twice, they take the driver's memory
    place = cut(placed(sizes, targets, rows).where("size > 0").select("source_no", "bucket", "key", "place", "source", "start", "size", passes.alias("passes")))
    last = slots.join(targets.select("source_no", F.col("target"), F.col("source_size")), "source_no").where(F.col("pass") >= passes).select("source_no", "block", F.col("words").alias("part"))
    spans = block_pieces(place).join(last, ["source_no", "block"]).where("lo < part")
    at = F.col("block") * BLOCK_WORDS - F.col("start")
    keys = ["source_no", "bucket", "key", "place"]
    spans = spans.select(*keys, (F.col("lo") + at).alias("a"), (F.least("hi", "part") + at).alias("b"))
    spans = cut(spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"), F.sum(F.col("b") - F.col("a")).alias("some")))
    plan = place.select(*keys, "source", "passes").join(spans, keys, "left")
    # repeated rows, which have one key, are told apart by their order
    copy = F.row_number().over(Window.partitionBy("key", "source").orderBy("place"))
    k, s, t, p, sp, so, cu = unused(docs, "key", "source_of", "copy", "passes", "spans", "some", "cut")
    plan = plan.select(F.col("key").alias(k), F.col("source").alias(s), copy.alias(t), F.col("passes").alias(p), F.col("spans").alias(sp), F.coalesce("some", F.lit(0)).alias(so))
    k2, t2 = unused(docs.select("*", *(F.lit(0).alias(c) for c in (k, t))), "own_key", "own_copy")
    texted = docs.withColumn(k2, _key(id_col, text_col)).withColumn(t2, F.row_number().over(Window.partitionBy(k2, source_col).orderBy(text_col)))
    joined = texted.join(plan, (texted[k2] == plan[k]) & texted[source_col].eqNullSafe(plan[s]) & (texted[t2] == plan[t]))
    words = n_words(F.col(text_col))
    split = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    joined = joined.withColumn(cu, F.when((F.col(so) > 0) & (F.col(so) < words), split))
    some = F.array_join(F.flatten(F.transform(sp, lambda x: F.slice(cu, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))), " ")
    rest = F.when(F.col(so) == 0, F.array().cast("array<string>")).when(F.col(cu).isNull(), F.array(F.col(text_col))).otherwise(F.array(some))
    out = joined.withColumn(text_col, F.explode(F.concat(F.array_repeat(F.col(text_col), F.col(p).cast("int")), rest)))
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.char_length(text_col).cast(docs.schema[count_col].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))
