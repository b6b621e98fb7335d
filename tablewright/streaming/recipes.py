"""Run a saved recipe on files as they arrive (R6 with Structured Streaming).

A recipe is re-run on new inputs.  For a folder that keeps receiving files,
``run_recipe_on_arrivals`` follows it with a Structured Streaming file source.
Each micro-batch hands its new files to ``foreachBatch``, where they are read by
the batch readers (so delimiters, headers, new JSONL keys and malformed lines are
treated as in a batch run), evaluated with the same operators, checked, and
written by the same sinks into ``<output>/batch-<id>`` (overwrite by batch id, so a
retried batch replaces its own output).  A failing check stops the stream.

The stream itself is over file names only: content is first read by the batch, once.  The columns and types of
the first batch's result are recorded beside the stream's progress and hold for all later ones:
columns that a batch lacks are null, a new column (``STREAM_NEW_COLUMN``) or a value type that doesn't fit
(``STREAM_TYPE_CHANGE``) stops the stream, so that outputs of different shape never lie side by side unnoticed.

Only row-local nodes are accepted between input and output (select, rename,
clean text, cast, filter, null handling): for them the union of per-batch
results equals the result over all files.  Sort, limit, deduplicate, group
by, join and union need all rows at once and are refused.  Progress is kept
in a checkpoint under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError
from ..operators.combine import conform, widen
from ..plans.pipeline import INPUT_TYPES, OUTPUT_TYPES, ROW_LOCAL, Evaluator, validate_pipeline
from ..session import ensure_checkpoint_dir
from ..sinks.files import write_csv, write_jsonl, write_parquet
from ..table import C, Table

#: Columns of Spark's file-listing source.
FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"


def _path_to(graph: dict, output_id: str) -> list[dict]:
    nodes = {n["id"]: n for n in graph["nodes"]}
    chain, current = [], output_id
    while True:
        node = nodes[current]
        chain.append(node)
        if node["type"] in INPUT_TYPES:
            return list(reversed(chain))
        ups = [e["source"]["nodeId"] for e in graph["edges"] if e["target"]["nodeId"] == current]
        if len(ups) != 1:
            raise TableError("STREAM_UNSUPPORTED", "Streaming needs a single chain from one input to the output.",
                             nodeId=current)
        current = ups[0]


def _arrivals(spark: SparkSession, input_dir: str, max_files: int):
    """Stream of the names of arriving files, at most ``max_files`` a batch; their content is not read."""
    files = spark.readStream.format("binaryFile").schema(FILE_COLUMNS).option("maxFilesPerTrigger", max_files)
    return files.load(input_dir).select(F.col("path").alias("file"))


def _recorded(spark: SparkSession, place: str, table: Table) -> T.StructType:
    """The schema that the first batch recorded at ``place``; the table's own, recorded now, if it is the first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
        spark.createDataFrame([(table.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(place)
    return T.StructType.fromJson(json.loads(spark.read.text(place).first()["value"]))


def _conformed(table: Table, schema: T.StructType) -> Table:
    """The table with the recorded columns; types that the recorded ones hold are widened."""
    known = {f.name: f.dataType for f in schema.fields}
    for f in table.schema.fields:
        if f.name not in known:
            raise TableError("STREAM_NEW_COLUMN", f"A batch has the column {f.name}, which the first one did not have.", column=f.name)
        if widen([known[f.name], f.dataType]) != known[f.name]:
            raise TableError("STREAM_TYPE_CHANGE", f"Column {f.name} was {known[f.name].simpleString()} and is {f.dataType.simpleString()} in a later batch.",
                             column=f.name)
    columns = [conform(C(n), table.dtype(n), t).alias(n) if n in table.columns else F.lit(None).cast(t).alias(n) for n, t in known.items()]
    return table.derive(table.df.select(*columns, *[C(h) for h in table.hidden]))


def run_recipe_on_arrivals(spark: SparkSession, graph: dict, output_node: str, input_dir: str, output_dir: str,
                           checkpoint: str | None = None, available_now: bool = True, max_files: int = 1000):
    """Start the stream; returns the ``StreamingQuery`` (``available_now``
    processes what is there and stops).  A batch takes ``max_files`` files at most."""
    result = validate_pipeline(graph)
    if not result["valid"]:
        first = result["firstIssue"]
        raise TableError(first["code"], first["message"], nodeId=first["nodeId"])
    chain = _path_to(graph, output_node)
    source, sink = chain[0], chain[-1]
    if sink["type"] not in OUTPUT_TYPES:
        raise TableError("STREAM_UNSUPPORTED", "The streamed node must be an output node.", nodeId=sink["id"])
    for node in chain[1:-1]:
        if node["type"] not in ROW_LOCAL and not node.get("disabled"):
            raise TableError("STREAM_UNSUPPORTED", f"Node type {node['type']} needs all rows and cannot stream.",
                             nodeId=node["id"])
    stream = _arrivals(spark, input_dir, max_files)
    fmt = sink["type"].split("-")[0]
    data = sink.get("data") or {}
    if checkpoint is None:
        checkpoint = os.path.join(ensure_checkpoint_dir(spark), "tablewright-streams", sink["id"])

    def per_batch(batch_df, batch_id):
        files = sorted(r["file"] for r in batch_df.distinct().collect())  # max_files rows at most
        if not files:
            return
        table = Evaluator(spark, graph, {source["id"]: files}, keep_order=False).table(sink["id"])
        table = _conformed(table, _recorded(spark, os.path.join(checkpoint, "tablewright-schema"), table))
        path = os.path.join(output_dir, f"batch-{batch_id:06d}")
        if fmt == "csv":
            write_csv(table, path, delimiter=data.get("delimiter", ","), header=data.get("header", True))
        elif fmt == "jsonl":
            write_jsonl(table, path)
        else:
            write_parquet(table, path)

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
