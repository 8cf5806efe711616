"""Readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.schema import MODEL


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table; columns reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All parquet files of a folder as one table; without any, or without the folder, an empty one."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """A CSV file, or all those of a folder; without a header, columns are named by the schema, in order."""
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_existing(spark: SparkSession, paths: dict[str, str], tag: str = "name") -> DataFrame | None:
    """The parquet tables that exist, each with its name; None if there is none."""
    out = None
    for name, path in paths.items():
        if _exists(spark, path):
            part = spark.read.parquet(path).withColumn(tag, F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def problem_column(df: DataFrame, names: tuple[str, ...] = ("problem", "Question")) -> str:
    """The first of the names that df has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of the columns {', '.join(names)} is there")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table given in place."""
    return spark.createDataFrame(rows, schema)


def with_position(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """df with each row's place (from 0) in a total order, by two-level counts: rows are dealt by range, counted by
    range, and numbered in their range, so no task holds them all."""
    from pyspark.sql import Window

    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = df.repartitionByRange(int(parts), *order).withColumn("_part", F.spark_partition_id())
    from tokenledger.operators.prep import cut

    dealt = cut(dealt)
    before = dealt.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_before")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_runs(df: DataFrame, path: str, run_name: str) -> None:
    """Results in a folder for each run and data set."""
    write_parquet(df.withColumn("run_name", F.lit(run_name)), path, "append", ("run_name", "dataset"))


def pending(work: DataFrame, done: DataFrame | None, *keys: str) -> DataFrame:
    """The rows of work whose key is not done yet."""
    return work if done is None else work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def run_resumable(work: DataFrame, stage, path: str, *keys: str, batches: int = 1) -> DataFrame:
    """stage(rows) for all rows of work, appended to path batch by batch; a new call goes on with what is missing."""
    spark = work.sparkSession
    if batches > 1:
        work = work.withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(batches)))
    for b in range(batches):
        part = work.where(F.col("_batch") == b).drop("_batch") if batches > 1 else work
        done = spark.read.parquet(path) if _exists(spark, path) else None
        stage(pending(part, done, *keys)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def run_stream(work: DataFrame, stage, path: str, log: str) -> None:
    """stage(rows) for all rows of a stream of work that are there and not done yet, then stops; a new call, after an end or a
    crash, goes on with what came since.

    The stream's log keeps which files or offsets each batch has and which batches are done, so finished keys are never looked
    up. A batch is written to a folder of its own, batch=<number>: when a crash comes between its writing and its entry in the
    log, the next call writes the same rows over it, and none comes twice. Read with read_stream_results().
    """

    def write(rows: DataFrame, batch: int) -> None:
        stage(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    work.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def read_stream_results(spark: SparkSession, path: str) -> DataFrame:
    """What run_stream() has written, batch by batch, without the numbers of batches."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def save_network(spark: SparkSession, layers: list[tuple], folder: str, **about) -> None:
    """Weights and biases as a table, and what is known about them as JSON."""
    rows = [(i, [[float(x) for x in r] for r in w], [float(x) for x in b]) for i, (w, b) in enumerate(layers)]
    spark.createDataFrame(rows, MODEL).coalesce(1).write.mode("overwrite").parquet(f"{folder}/layers")
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load_network(spark: SparkSession, folder: str) -> tuple[list[tuple], dict]:
    """What save_network() wrote; a network has few layers, so they come to the driver."""
    layers = [(r["w"], r["b"]) for r in spark.read.schema(MODEL).parquet(f"{folder}/layers").orderBy("layer").collect()]
    return layers, json.loads(spark.read.text(f"{folder}/about").first()[0])
