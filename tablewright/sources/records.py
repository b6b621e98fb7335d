"""Records of CSV files whose quoted cells hold line breaks, read in splits.

A line leaves the reader outside or inside a quoted cell, depending on where it started.  So a block of lines (one
split of a file) is a function of two states.  One pass finds that function for every block, together with the lines
at its borders for either start: those up to the first record end, and those from the last record's start.  The start
of each block then follows from the blocks before it in its file, one narrow row per block.  The second pass, which is the read
itself, runs over the lines of each block from its start and gives the records that lie in it whole; records
that cross a border are put together from the lines at the borders.  No text is shuffled but those.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# The mapInArrow helpers below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a worker hands over at a time.
BATCH = 2_000
BLOCKS = "file string, block bigint, " + ", ".join(f"{s}_{c}" for s in ("out", "in") for c in ("end boolean", "head string", "tail string", "at bigint", "records bigint"))


def line_state(sep: str):
    """Function (line, inside) -> whether the line's end lies inside a quoted cell."""
    start = f"(^|{re.escape(sep)})"
    whole, opened = re.compile(start + r'"(?:[^"]|"")*+"'), re.compile(start + '"')

    def after(line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        return opened.search(whole.sub(r"\1x", '"' + line if inside else line)) is not None
    return after


class Reading:
    """The lines of a block read from one start: records that are whole, the lines before the first and after the last."""

    def __init__(self, after, inside: bool, keep: bool):
        self.after, self.inside, self.keep = after, inside, keep
        self.crosses, self.head, self.lines, self.at, self.whole, self.records = inside, [], [], None, [], 0

    def take(self, line: str, place: int) -> None:
        if not self.inside and line == "":
            return  # blank lines between records are no rows
        if not self.inside:
            self.lines, self.at = [], place
        target = self.head if self.crosses else self.lines
        target.append(line)
        self.inside = self.after(line, self.inside)
        if not self.inside:
            if self.crosses:
                self.crosses = False
            else:
                self.records += 1
                if self.keep:
                    self.whole.append((self.at, "\n".join(self.lines)))
            self.lines = []

    def borders(self) -> tuple:
        """(inside at the end, lines that belong to a record begun before, lines of a record not ended, its place, records ended)"""
        open_ = self.inside and not self.crosses
        return self.inside, "\n".join(self.head) if self.head else None, "\n".join(self.lines) if open_ else None, self.at if open_ else None, self.records


def _runs(batches, columns: tuple):
    """Consecutive rows of one (file, block): key, rows."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns]):
            if row[:2] != key:
                if key is not None:
                    yield key, rows, True
                key, rows = row[:2], []
            rows.append(row)
            if len(rows) >= BATCH:
                yield key, rows, False
                rows = []
    if key is not None:
        yield key, rows, True


def _line(value: str | None, block: int, first: bool) -> str:
    return (value or "").removeprefix("﻿") if first and block == 0 else value or ""


def _find_blocks(sep: str):
    def run(batches):
        both, first, out = None, True, []
        for (file, block), rows, last in _runs(batches, ("file", "block", "id", "value")):
            if both is None:
                both, first = [Reading(line_state(sep), inside, False) for inside in (False, True)], True
            for _, _, place, value in rows:
                line, first = _line(value, block, first), False
                for reading in both:
                    reading.take(line, place)
            if last:
                out.append((file, block, *both[0].borders(), *both[1].borders()))
                both = None
        kinds = [pa.string(), pa.int64(), *[pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()] * 2]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])
    return run


def _read_blocks(sep: str, header: bool):
    def run(batches):
        reading, first, skip = None, True, False
        for (file, block), rows, last in _runs(batches, ("file", "block", "id", "value", "inside")):
            if reading is None:
                reading, first, skip = Reading(line_state(sep), rows[0][4], True), True, header and block == 0
            for _, _, place, value, _ in rows:
                line, first = _line(value, block, first), False
                reading.take(line, place)
            found, reading.whole = reading.whole, []
            if found and skip:
                found, skip = found[1:], False
            yield pa.RecordBatch.from_arrays([pa.array([r for _, r in found], pa.string()), pa.array([file] * len(found), pa.string()),
                                              pa.array([block] * len(found), pa.int64()), pa.array([i for i, _ in found], pa.int64())],
                                             names=["text", "file", "block", "id"])
            if last:
                reading = None
    return run


def csv_records(spark: SparkSession, files: list[str], sep: str, header: bool, encoding: str) -> DataFrame:
    """(text, file, block, id) of every record; ``block`` and ``id`` are of its first line.  Headers (each file's first record) are left out."""
    lines = spark.read.option("encoding", encoding).text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    path = scratch_path(spark, "csv-blocks")
    lines.mapInArrow(_find_blocks(sep), BLOCKS).write.parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)  # one row per split
    # a block's start: what the last block with one end for both starts left, turned by each later block that swaps the two
    whole = Window.partitionBy("file").orderBy("block")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    fixed, swaps = F.when(F.col("out_end") == F.col("in_end"), F.col("out_end")), (F.col("out_end") & ~F.col("in_end")).cast("int")
    turned = blocks.withColumn("fixed", fixed).withColumn("turns", F.sum(swaps).over(whole))
    turned = turned.withColumn("since", F.coalesce(F.last(F.when(F.col("fixed").isNotNull(), F.col("turns")), ignorenulls=True).over(before), F.lit(0)))
    odd = (F.coalesce(F.lag("turns").over(whole), F.lit(0)) - F.col("since")) % 2 == 1
    started = turned.withColumn("inside", F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(False)) != odd)
    read = lines.join(F.broadcast(started.select("file", "block", "inside")), ["file", "block"]) \
        .mapInArrow(_read_blocks(sep, header), "text string, file string, block bigint, id bigint")
    # lines at the borders: a record begins with a tail and goes on with the heads of the next blocks
    own = lambda c: F.when(F.col("inside"), F.col(f"in_{c}")).otherwise(F.col(f"out_{c}"))
    parts = started.select("file", "block", F.explode(F.array(
        F.struct(F.lit(0).alias("turn"), own("head").alias("text"), F.lit(None).cast("long").alias("id")),
        F.struct(F.lit(1).alias("turn"), own("tail").alias("text"), own("at").alias("id")))).alias("p")).select("file", "block", "p.*").filter("text is not null")
    record = F.sum("turn").over(Window.partitionBy("file").orderBy("block", "turn"))
    pieces = parts.withColumn("record", record).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "turn", "text", "id"))).alias("p"))
    crossing = pieces.select(F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), "file",
                             F.get("p", F.lit(0))["block"].alias("block"), F.get("p", F.lit(0))["id"].alias("id"))
    if header:  # a header that crosses a border is the first record of its file
        late = blocks.filter("block = 0 and out_records = 0").select("file", F.lit(0).cast("long").alias("block"))
        crossing = crossing.join(late, ["file", "block"], "left_anti").select("text", "file", "block", "id")
    return read.unionByName(crossing)
