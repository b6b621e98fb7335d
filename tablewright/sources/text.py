"""CSV / TSV (S1, S2) and JSONL (S3, S3a) sources.

CSV cells are read as text (``''`` for a blank cell, short rows padded with
``''``).  One task per file looks at its first 64 KiB: delimiter (scored when
``delimiter='auto'``) and header.  Files with the same delimiter and header
are read together; groups are united by column name, never by position.  A
row with more cells than the header, text behind a closing quote and, unless ``multi_line`` is on, a line
that ends inside an open quote are errors (``CSV_ROW_WIDTH``, ``CSV_QUOTE_TEXT``,
``CSV_OPEN_QUOTE``).  Lines are judged and cut into cells in one pass: the CSV reader hands over whole
lines without the headers, the rows may carry the check, and ``from_csv`` gives the cells.
:func:`csv_rejects` lists the lines at fault.

JSONL keeps the first-seen key order of the whole input.  One pass parses each
line twice: as a variant, which tells whether it is one JSON object and
whose merged types are the column types (conflicting types become text), and
for its keys in order, whose first (file, block, line, place) are found; nothing wider than a
key is unpivoted.  The read itself parses each line once more.  Errors carry the 1-based line
number inside the file, computed only when there is a failing line.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
import uuid
from collections import Counter
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError, require_distinct
from ..functions import sniff as S
from ..table import C, Check, CheckRule, OrderKey, Table, hidden_name
from .records import csv_records

# The mapInArrow helpers below run in Python workers, which need not have
# this package installed: ship this module's functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Delimiter names and the candidates of auto-detection, in
# tie-break order.
DELIMITER_NAMES = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|"}
CANDIDATES = (",", "\t", ";", "|")
SAMPLE_CHARS = 65536
SAMPLE_LINES = 12


def _paths(path) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def resolve_delimiter(delimiter) -> str | None:
    if delimiter in (None, "", "auto"):
        return None
    return DELIMITER_NAMES.get(delimiter, delimiter)


# -- S2: delimiter detection ------------------------------------------------------

def _line_counts(text: str, delimiter: str) -> list[int]:
    """Delimiter count per logical line of the sample (quoted text ignored,
    a quoted newline does not end a line), for the first non-blank lines."""
    sample = text[:SAMPLE_CHARS]
    # Quoted runs ("" is an escaped quote) count as content but hide delimiters.
    masked = re.sub(r'"(?:[^"]|"")*"', "x", sample)
    tail = masked.find('"')
    if tail >= 0:
        masked = masked[:tail]      # unterminated quote: the rest is one open cell
        open_line = True
    else:
        open_line = False
    lines = re.split(r"\r\n|\r|\n", masked)
    if open_line and lines:
        lines = lines[:-1]
    counts = []
    for line in lines:
        n = line.count(delimiter)
        if n or line.strip():
            counts.append(n)
        if len(counts) >= SAMPLE_LINES:
            break
    return counts


def score_delimiters(text: str) -> str:
    """Best delimiter for a file head: rows that agree on a count win.
    score = 100*rows with the modal count + 4*modal count
            - 25*rows with another count - 15*rows without the delimiter.
    Ties keep the earlier candidate; no candidate at all gives a comma."""
    best, best_score = ",", None
    for delim in CANDIDATES:
        counts = _line_counts(text, delim)
        hits = [c for c in counts if c > 0]
        if not hits:
            continue
        freq = Counter(hits)
        mode_count, mode_freq = max(freq.items(), key=lambda kv: (kv[1], kv[0]))
        score = mode_freq * 100 + mode_count * 4 - (len(hits) - mode_freq) * 25 - (len(counts) - len(hits)) * 15
        if best_score is None or score > best_score:
            best, best_score = delim, score
    return best


def _first_record(text: str, delimiter: str) -> list[str] | None:
    """Cells of the first record of a file head (it may hold quoted newlines)."""
    return next((r for r in csv.reader(io.StringIO(text.lstrip("\ufeff"), newline=""), delimiter=delimiter) if r), None)


def _head_reader(delimiter: str | None):
    """mapInArrow: per file, join lines until the sample is full, find its delimiter and first
    record, and stop reading (the rest of the file is never decoded)."""
    def run(batches):
        heads: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}
        done = set()
        for batch in batches:
            for value, file in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist()):
                if file in done:
                    continue
                heads.setdefault(file, []).append(value or "")
                sizes[file] = sizes.get(file, 0) + len(value or "") + 1
                if sizes[file] >= SAMPLE_CHARS:
                    done.add(file)
            if heads and len(done) == len(heads):
                break
        files = list(heads)
        texts = ["\n".join(heads[f]) for f in files]
        delims = [delimiter or score_delimiters(t) for t in texts]
        records = [_first_record(t, d) for t, d in zip(texts, delims)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(files, pa.string()), pa.array(delims, pa.string()),
             pa.array([None if r is None else json.dumps(r) for r in records], pa.string())],
            names=["file", "delimiter", "record"])
    return run


def _file_heads(spark: SparkSession, path, delimiter: str | None, encoding: str) -> list:
    """(file, delimiter, first record as JSON) of every file; one row per file, as in the driver's own file listing."""
    conf = spark.conf
    saved = {k: conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    # One file per task, never split: each task reads only its file's head.
    conf.set("spark.sql.files.maxPartitionBytes", str(1 << 40))
    conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
    try:
        text = spark.read.option("encoding", encoding).text(_paths(path)) \
            .select(F.col("value"), F.col("_metadata.file_path").alias("file"))
        return text.mapInArrow(_head_reader(delimiter), "file string, delimiter string, record string").collect()
    finally:
        for k, v in saved.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def detect_delimiters(spark: SparkSession, path, encoding: str = "utf-8") -> DataFrame:
    """(file, delimiter) for every file under ``path``; one task per file."""
    rows = [(r["file"], r["delimiter"]) for r in _file_heads(spark, path, None, encoding)]
    return spark.createDataFrame(rows, "file string, delimiter string")


# -- S1: CSV ----------------------------------------------------------------------------

def _header_names(cells: list[str], header: bool) -> tuple:
    if not header:
        return tuple(f"column_{i + 1}" for i in range(len(cells)))
    names = tuple(c if c.strip() else f"column_{i + 1}" for i, c in enumerate(cells))
    require_distinct(names, "COLUMN_NAME_COLLISION", "The header's column")
    return names


def _csv_groups(spark, path, delimiter, header: bool, encoding: str) -> dict:
    """{(delimiter, column names): files}; files without any record are left out."""
    groups: dict[tuple, list[str]] = {}
    for row in _file_heads(spark, path, resolve_delimiter(delimiter), encoding):
        if row["record"] is not None:
            key = (row["delimiter"], _header_names(json.loads(row["record"]), header))
            groups.setdefault(key, []).append(unquote(row["file"]))  # Spark escapes the paths it reports
    return {k: sorted(groups[k]) for k in sorted(groups, key=lambda k: min(groups[k]))}


def _options(sep: str, header: bool, encoding: str, multi_line: bool) -> dict:
    return dict(header=header, enforceSchema=True, sep=sep, quote='"', escape='"', encoding=encoding, multiLine=multi_line,
                mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


#: A separator that no line holds, so that the CSV reader hands over whole lines.
NEVER = "\x01\x02tablewright\x02\x01"
#: What stands for a quoted cell while a line is judged.
QUOTED = "\x01quoted\x02"


def _csv_lines(spark, files: list[str], header: bool, encoding: str) -> DataFrame:
    """(text, file, block, id) of every line that is not blank; the reader drops the headers."""
    options = _options(NEVER, header, encoding, False) | {"quote": "", "escape": ""}
    raw = spark.read.schema("text string").options(**options).csv(files)
    return raw.select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("id"))


def _line_reason(text, sep: str, width: int):
    """Why a line can't be taken whole; null for good lines.  Lines without a quote only have their separators counted."""
    count = lambda t: (F.length(t) - F.length(F.replace(t, F.lit(sep), F.lit("")))) / len(sep) + 1
    # a quote opens a cell only at its start; inside an unquoted cell it is an ordinary character
    start, end = f"(^|{re.escape(sep)})", f"(?!\\z|{re.escape(sep)})"
    # quoted cells are taken one after the other, so what lies inside them is never taken for a cell
    plain = F.regexp_replace(text, start + r'"(?:[^"]|"")*+"', f"$1{QUOTED}")
    with_quotes = (F.when(plain.rlike(start + '"'), F.lit("CSV_OPEN_QUOTE"))
                   .when(plain.rlike(start + QUOTED + end), F.lit("CSV_QUOTE_TEXT"))
                   .when(count(plain) > width, F.lit("CSV_ROW_WIDTH")))
    return F.when(text.contains('"'), with_quotes).when(count(text) > width, F.lit("CSV_ROW_WIDTH"))


def _judged_lines(spark, files, sep, names, header, encoding, multi_line) -> DataFrame:
    """Lines, or with ``multi_line`` records, with the reason why one can't be taken whole."""
    lines = csv_records(spark, files, sep, header, encoding) if multi_line else _csv_lines(spark, files, header, encoding)
    return lines.withColumn("reason", _line_reason(F.col("text"), sep, len(names)))


def _csv_rules(width: int) -> tuple:
    what = {"CSV_ROW_WIDTH": f"A row has more cells than the {width} columns of its header.",
            "CSV_QUOTE_TEXT": "A quoted cell has text behind its closing quote.",
            "CSV_OPEN_QUOTE": "A quote is still open at the end of a line; multi_line=True reads cells with line breaks."}
    return tuple(CheckRule(code, message, F.coalesce(F.col("reason") == code, F.lit(False)), F.col("text")) for code, message in what.items())


def _read_csv_group(spark, files, sep, names, header, encoding, multi_line, keep_order, carry):
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = _options(sep, header, encoding, multi_line)
    fp, bs, rid = (hidden_name(tag) for tag in ("file", "block", "line"))
    order = (OrderKey(fp), OrderKey(bs), OrderKey(rid)) if keep_order else ()
    lines = _judged_lines(spark, files, sep, names, header, encoding, multi_line)
    judged = Table(lines).checked(_csv_rules(len(names))) if carry else Table(lines, checks=(Check(lines, _csv_rules(len(names))),))
    parse = {k: str(options[k]) for k in ("sep", "quote", "escape", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace")}
    places = [F.col("file").alias(fp), F.col("block").alias(bs), F.col("id").alias(rid)]
    cut = judged.df.select(F.from_csv("text", schema.simpleString()[len("struct<"):-1].replace(":", " "), parse).alias("r"), "file", "block", "id")
    cells = [F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)]
    return judged.derive(cut.select(*cells, *(places if keep_order else [])), order)


def read_csv(spark: SparkSession, path, delimiter="auto", header: bool = True, encoding: str = "utf-8",
             keep_order: bool = False, multi_line: bool = False, limit: int | None = None, carry: bool = False) -> Table:
    """Read CSV/TSV files as text columns.

    Lines at fault are found by a check of their own, a second pass, and can be looked at until then; with ``carry`` the rows
    carry the check: whatever reads a line at fault fails.  ``multi_line`` allows line breaks in quoted cells, for one more
    pass over the lines; files are split as others are."""
    from ..operators.combine import union_tables
    from ..operators.rows import limit_rows
    groups = _csv_groups(spark, path, delimiter, header, encoding)
    tables = [_read_csv_group(spark, files, sep, names, header, encoding, multi_line, keep_order, carry)
              for (sep, names), files in groups.items()]
    if not tables:
        return Table(spark.createDataFrame([], T.StructType([])))
    table = tables[0] if len(tables) == 1 else union_tables(tables, "name", max_inputs=len(tables))
    by_delimiter: dict[str, list] = {}
    for (sep, _), files in groups.items():
        by_delimiter.setdefault(sep, []).extend(files)
    table.meta["delimiters"] = by_delimiter
    return limit_rows(table, limit) if limit is not None else table


def csv_rejects(spark: SparkSession, path, delimiter="auto", header: bool = True, encoding: str = "utf-8",
                multi_line: bool = False) -> DataFrame:
    """Every record that :func:`read_csv` can't take whole, as (file, reason, text)."""
    parts = []
    for (sep, names), files in _csv_groups(spark, path, delimiter, header, encoding).items():
        judged = _judged_lines(spark, files, sep, names, header, encoding, multi_line)
        parts.append(judged.filter("reason is not null").select("file", "reason", "text"))
    out = spark.createDataFrame([], "file string, reason string, text string")
    for part in parts:
        out = out.union(part)
    return out


# -- S3: JSONL --------------------------------------------------------------------------

def _jsonl_lines(spark, paths, encoding):
    text = spark.read.option("encoding", encoding).text(paths)
    lines = text.select(
        F.regexp_replace(F.col("value"), "^﻿", "").alias("raw"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    return lines.withColumn("line", S.js_trim(F.col("raw")))


#: Lines of this many bytes or more are beyond what a VARIANT holds.
VARIANT_BYTES = 16_000_000


def _judged(lines: DataFrame) -> DataFrame:
    """Adds ``json`` (the line as a variant, inside an array) and ``reason`` (why it is no single JSON object; null for good lines).

    A JSON parser stops behind the first value of a text.  So the line is parsed as the first element of an array whose second
    is a mark that no line can hold: only where exactly one whole value stands before the mark is it the second element."""
    mark = uuid.uuid4().hex
    line, json_ = F.col("line"), F.col("json")
    parsed = lines.withColumn("json", F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{mark}"]'))))
    alone = F.coalesce(F.try_variant_get(json_, "$[1]", "string") == mark, F.lit(False))
    # one JSON value by then, so its first character tells its kind
    return parsed.withColumn("reason", F.when(F.octet_length(line) >= VARIANT_BYTES, F.lit("JSONL_TOO_LONG"))
                             .when(~alone, F.lit("JSONL_PARSE")).when(~line.startswith("{"), F.lit("JSONL_OBJECT")))


def jsonl_line_number(lines: DataFrame, file: str, block: int, row_id: int) -> int:
    """1-based line number of one row: rows of earlier blocks of the same file
    plus rows before it in its block (one more pass over the input)."""
    same = lines.filter(F.col("file") == file)
    before = same.filter((F.col("block") < block) | ((F.col("block") == block) & (F.col("id") < row_id))).count()
    return before + 1


def _raise_bad_line(lines: DataFrame, bad) -> None:
    at = bad["pos"]
    number = jsonl_line_number(lines, at["file"], at["block"], at["id"])
    what = {"JSONL_PARSE": "is not valid JSON", "JSONL_OBJECT": "holds JSON that is not an object",
            "JSONL_TOO_LONG": f"has {VARIANT_BYTES} bytes or more"}[bad["reason"]]
    raise TableError(bad["reason"], f"Line {number} {what}.", line=number, file=at["file"])


def read_jsonl(spark: SparkSession, path, strict: bool = True, keep_order: bool = False, encoding: str = "utf-8",
               schema: T.StructType | None = None, limit: int | None = None) -> Table:
    """Read JSON Lines: one object per non-blank line, columns in first-seen
    key order, missing keys null.  ``strict`` raises ``JSONL_PARSE`` /
    ``JSONL_OBJECT`` with the first failing line; otherwise bad lines are
    left out and listed by :func:`jsonl_rejects`."""
    from ..operators.rows import limit_rows
    paths = _paths(path)
    lines = _jsonl_lines(spark, paths, encoding).filter(F.col("line") != "")
    if limit is not None and not keep_order:
        lines = lines.limit(limit)  # keys, types and errors of the rows read, not of the whole input
    # One row per line with its value, and one per key with its position alone; bad lines have no keys.
    keys_of = F.when(F.col("reason").isNull(), F.json_object_keys("line"))
    none = F.lit(None)
    whole = F.array(F.struct(none.cast("string").alias("key"), F.lit(-1).alias("k"), F.col("reason").alias("reason"),
                             F.when(F.col("reason").isNull(), F.try_variant_get("json", "$[0]", "variant")).alias("value")))
    each = F.transform(F.coalesce(keys_of, F.array().cast("array<string>")), lambda key, k: F.struct(
        key.alias("key"), k.alias("k"), none.cast("string").alias("reason"), none.cast("variant").alias("value")))
    entries = _judged(lines).select("file", "block", "id", F.explode(F.concat(whole, each)).alias("e"))
    place = F.struct("file", "block", "id")
    found = entries.groupBy(F.col("e.key").alias("key")).agg(
        F.min(F.struct(place.alias("pos"), F.col("e.k").alias("k"))).alias("first"),
        F.call_function("schema_of_variant_agg", F.col("e.value")).alias("type"),
        F.min_by(F.struct(place.alias("pos"), F.col("e.reason").alias("reason")), F.when(F.col("e.reason").isNotNull(), place)).alias("first_bad"),
    ).collect()
    line_row = next((r for r in found if r["key"] is None), None)
    if strict and line_row and line_row["first_bad"]:
        _raise_bad_line(_jsonl_lines(spark, paths, encoding), line_row["first_bad"])
    keys = [r for r in found if r["key"] is not None]
    # strict reads have no bad lines left
    good = lines if strict else _judged(lines).filter(F.col("reason").isNull())
    names = [r["key"] for r in sorted(keys, key=lambda r: (tuple(r["first"]["pos"]), r["first"]["k"]))]
    if schema is None:
        by_name = field_types(line_row["type"] if line_row else None, names)
    else:
        by_name = {f.name: f.dataType for f in schema.fields}
        names = [n for n in names if n in by_name] + [n for n in by_name if n not in names]
    struct = T.StructType([T.StructField(n, by_name.get(n, T.StringType())) for n in names])
    parsed = good.select(F.from_json(F.col("line"), struct).alias("r"), "file", "block", "id")
    cols = [F.col("r").getField(n).alias(n) for n in names]
    order = ()
    if keep_order:
        fp, bs, rid = hidden_name("file"), hidden_name("block"), hidden_name("line")
        cols += [F.col("file").alias(fp), F.col("block").alias(bs), F.col("id").alias(rid)]
        order = (OrderKey(fp), OrderKey(bs), OrderKey(rid))
    table = Table(parsed.select(*cols), order)
    return limit_rows(table, limit) if limit is not None else table


def field_types(merged: str | None, names: list[str]) -> dict:
    """Spark type of each key from the merged type of all lines: objects
    become structs, numbers that are not all integers become double,
    conflicting or unknown types become text (the JSON text of the value)."""
    text = (merged or "").replace("OBJECT<", "STRUCT<")
    text = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", text)
    text = re.sub(r"\b(VARIANT|VOID)\b", "STRING", text)
    known: dict = {}
    if text.startswith("STRUCT<"):
        known = {f.name: f.dataType for f in T.DataType.fromDDL(text).fields}
    return {n: known.get(n, T.StringType()) for n in names}


def jsonl_rejects(spark: SparkSession, path, encoding: str = "utf-8") -> DataFrame:
    """Every malformed line as (file, line, reason), line numbers 1-based.

    Line numbers come from per-block line counts (one small aggregate) turned
    into per-file offsets; no global numbering of the input is needed."""
    lines = _jsonl_lines(spark, _paths(path), encoding)
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    from pyspark.sql import Window
    w = Window.partitionBy("file").orderBy("block")
    offsets = blocks.select("file", "block", "first_id", (F.sum("n").over(w) - F.col("n")).alias("off"))
    bad = _judged(lines.filter(F.col("line") != "")).select("file", "block", "id", "reason").filter(F.col("reason").isNotNull())
    joined = bad.join(offsets, ["file", "block"])
    return joined.select("file", (F.col("off") + F.col("id") - F.col("first_id") + 1).alias("line"), "reason")
