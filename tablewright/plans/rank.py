"""Consecutive row numbers in table order, without a single-partition step.

``row_number()`` over an un-partitioned window moves every row into one task.
Instead: sort once (range-partitioned), tag rows with
``monotonically_increasing_id`` (partition index in the high bits), write the
tagged rows once to the shared checkpoint folder (this cuts the lineage, so
the ids are fixed even if executors are lost later; the folder goes when the
application ends), count rows per sort
partition (at most one row per partition), turn the counts into offsets and
add them back with a broadcast join whose size is bounded by the number of
sort partitions.  The rank only depends on the stored ids, not on how the
files are split when they are read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ..table import C, Table, as_table, hidden_name

LOCAL_BITS = 33


def with_rank(table, name: str = "rank") -> DataFrame:
    """Visible columns plus ``name`` = 1..n in the table's order."""
    t = as_table(table)
    if not t.order:
        raise ValueError("with_rank needs an ordered table")
    spark = t.df.sparkSession
    folder = scratch_path(spark, "rank")
    mid = hidden_name("mid")
    tagged = t.df.orderBy(*[k.column() for k in t.order]).select(*[C(c) for c in t.columns]) \
        .withColumn(mid, F.monotonically_increasing_id())
    with t.explained():
        tagged.write.mode("overwrite").parquet(folder)
    stable = spark.read.parquet(folder)
    part = F.shiftright(C(mid), LOCAL_BITS)
    local = C(mid).bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    counts = stable.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("off"))
    joined = stable.join(F.broadcast(offsets), part == F.col("p"))
    return joined.select(*[C(c) for c in t.columns], (F.col("off") + local + 1).cast("long").alias(name))
