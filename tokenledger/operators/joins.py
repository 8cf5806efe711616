"""Joins with the guards that the analyses rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, after a check that no key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the key {dict(zip(keys, twice[0]))} occurs more than once")
    return df


def attach(left: DataFrame, right: DataFrame, *keys: str, one_to_one: bool = False) -> DataFrame:
    """A left join on keys that are unique on the right (and on the left, if one_to_one). Null keys match nothing."""
    if one_to_one:
        assert_unique(left, *keys)
    return left.join(assert_unique(right, *keys), list(keys), "left")


def strict_lookup(left: DataFrame, table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """left with value from a table of keys, the last of several; an error when rows are read if one has none."""
    last = table.groupBy(key).agg(F.max_by(value, order).alias(value), F.lit(True).alias("_found"))
    joined = left.join(last, key, "left")
    found = F.when(F.col("_found"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.withColumn(value, found).drop("_found")


def paired(a: DataFrame, b: DataFrame, key: str, columns: list[str], suffixes: tuple[str, str] = ("_r", "_o")) -> DataFrame:
    """An inner join whose columns are told apart by suffixes."""
    x = a.select(key, *(F.col(c).alias(c + suffixes[0]) for c in columns))
    return x.join(b.select(key, *(F.col(c).alias(c + suffixes[1]) for c in columns)), key)


def by_position(a: DataFrame, b: DataFrame, position: str = "row_idx") -> DataFrame:
    """Rows of one position side by side; both must have as many rows."""
    if a.count() != b.count():
        raise ValueError("the tables differ in their numbers of rows")
    return a.join(b, position)


def once_per_text(df: DataFrame, column: str, stage) -> DataFrame:
    """stage() over the distinct texts of a column, joined back: costly work is done once a text."""
    done = stage(df.select(column).where(F.col(column).isNotNull()).distinct())
    return df.join(done, column, "left")


def _cache_table(spark: SparkSession, table: str, folder: str, column: str, buckets: int) -> bool:
    """Whether there is a cache in a folder; it is a table of this session afterwards."""
    if spark.catalog.tableExists(table):
        return True
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return False
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema.fields)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (_key, `{column}`) SORTED BY (_key, `{column}`) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return True


def cached_per_text(df: DataFrame, column: str, stage, table: str, folder: str, buckets: int = 64) -> DataFrame:
    """As once_per_text(), with what stage() made kept from run to run: a table in a shared folder, bucketed by the text
    and a hash of it. Only texts that it lacks go through stage(), whose rows are appended; joins with it read it bucket by bucket, without
    a shuffle of its rows. Texts are compared whole, not by their hashes; null texts get nulls. One run at a time may write. The
    number of buckets belongs to the folder and stays as it was at first.
    """
    spark = df.sparkSession
    key = F.xxhash64(F.col(f"`{column}`"))
    texts = df.select(F.col(f"`{column}`")).where(F.col(f"`{column}`").isNotNull()).distinct().withColumn("_key", key)
    new = texts
    if _cache_table(spark, table, folder, column, buckets):
        new = texts.join(spark.table(table).select("_key", column).hint("merge"), ["_key", column], "left_anti")
    made = stage(new.select(column)).withColumn("_key", key)
    made.write.bucketBy(buckets, "_key", column).sortBy("_key", column).option("path", folder).mode("append").saveAsTable(table)
    found = spark.table(table)
    return df.withColumn("_key", key).join(found.hint("merge"), ["_key", column], "left").select(*(f"`{c}`" for c in df.columns), *(f"`{c}`" for c in found.columns if c not in (column, "_key")))


def keep_members(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def with_group_max(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """df with the largest value of a column in each key's rows."""
    return df.join(df.groupBy(*keys).agg(F.max(column).alias(name)), keys, "left")
