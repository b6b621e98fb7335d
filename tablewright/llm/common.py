"""Helpers shared by the operators: staged tables and spread-out running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows that one bucket of a running total holds on average.
ROWS_PER_BUCKET = 20_000
#: Characters of a hex digest used as a number: 52 bits, exact in a double and a long.
HEX_DIGITS = 13
HEX_RANGE = 16 ** HEX_DIGITS


def stage_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared checkpoint folder, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablewright-llm/{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage with files every executor sees, so what was computed
    (and any row id in it) stays the same when executors are lost.
    """
    path = stage_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def full_text(text: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def id_key(column: str, name: str) -> list[Column]:
    """Two plain columns that are equal exactly for equal ids, null included.

    A join and a window on them share one exchange, as a null-safe comparison would not."""
    return [F.coalesce(F.col(column).cast("string"), F.lit("")).alias(name), F.col(column).isNull().alias(f"{name}_null")]


def hex_number(digest: Column) -> Column:
    """The first 52 bits of a hex digest as a long."""
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def bucket_count(rows: int) -> int:
    """Buckets for a running total over ``rows`` rows; grows with the input."""
    return max(1, -(-rows // ROWS_PER_BUCKET))


def dealt_buckets(df: DataFrame, group: str, place: str, order: list[str], buckets: int, most: int = 2 * ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``__bucket``, which grows with the order of a group's rows.

    Buckets are ranges of ``place``.  If one of them gets more than ``most`` rows, as many rows have one
    place (equal or null ids), the rows are cut into ranges of their whole order instead, down to a row id for
    rows that are equal throughout, and staged once.
    """
    cut = F.floor(F.col(place) / F.lit(HEX_RANGE) * F.lit(buckets)).cast("long")
    dealt = df.withColumn("__bucket", cut)
    if (dealt.groupBy(group, "__bucket").count().agg(F.max("count")).first()[0] or 0) <= most:
        return dealt.withColumn("__row", F.lit(0).cast("long"))
    keys = [F.col(group), F.col(place), *[F.col(c).asc_nulls_last() for c in order], F.col("__row")]
    ranges = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(buckets, *keys)
    return staged(ranges.withColumn("__bucket", F.spark_partition_id().cast("long")), "running-total")


def running_total(df: DataFrame, group: str, place: str, order: list[str], value: str, out: str,
                  buckets: int, most: int = 2 * ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before.

    Rows are ordered by ``place`` (a long in [0, HEX_RANGE), spread evenly,
    such as a hash) and then by ``order``; the rows of one group are dealt into
    ``buckets`` ranges (``dealt_buckets``).  Sums of whole buckets are a small table
    (one row per group and bucket) that is accumulated per group; inside a
    bucket a window does the rest.  No task holds more than a bucket of a
    group, however large the group and however many rows share a place.  ``group`` must not be null.
    """
    dealt = dealt_buckets(df, group, place, order, buckets, most)
    sums = dealt.groupBy(F.col(group).alias("__g"), F.col("__bucket").alias("__b")).agg(F.sum(value).alias("__s"))
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__g", "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = (Window.partitionBy(group, "__bucket").orderBy(place, *[F.col(c).asc_nulls_last() for c in order], "__row")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = dealt.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(base, (F.col(group) == F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn(out, (F.col("__base") + F.col("__local")).cast("long")) \
        .drop("__bucket", "__row", "__g", "__b", "__base", "__local")
