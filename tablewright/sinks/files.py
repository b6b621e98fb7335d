"""CSV (K1), JSONL (K2) and Parquet (K3) sinks and output naming (K4).

Every sink sorts by the table's order if it has one (a range-partitioned sort, so part
files come out in order) and writes with one Spark job.  Checks that the rows carry are made by
that job: the files are written beside their place and moved there only when the whole
job is done, so a failing check leaves what was there before.  Checks that the rows don't carry
run first.  ``single_file=True`` funnels the result through one task and is meant for small results.

CSV bytes: header row, CRLF after every row, no BOM, a cell is quoted only
when it holds the delimiter, a quote, CR or LF (quotes doubled), null and
``''`` are both an empty field (``""`` in a table of one column, where an
empty line would be lost).  Lines are built with column expressions and
written as text, so newlines inside cells are kept as they are.
"""

from __future__ import annotations

import contextlib
import json
import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require_distinct
from ..functions import sniff as S
from ..table import C, Table, as_table

FORMAT_EXTENSIONS = {"csv": "csv", "jsonl": "jsonl", "parquet": "parquet"}
# Known output extensions replaced at the end of a name,
# characters not allowed in file names, maximum base name length.
KNOWN_EXTENSIONS = ("csv", "tsv", "jsonl", "json", "parquet")
UNSAFE_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
MAX_BASE_LENGTH = 120


def output_filename(name, fmt: str) -> str:
    """File name for an output: base + extension of the real format; unsafe
    characters become ``-``; blank becomes ``output``; base at most 120
    characters; only a terminal known extension is replaced."""
    ext = FORMAT_EXTENSIONS[fmt]
    base = re.sub(UNSAFE_CHARS, "-", str(name or "")).strip()
    base = re.sub(r"\.(" + "|".join(KNOWN_EXTENSIONS) + r")$", "", base, flags=re.IGNORECASE)
    base = base.strip(" .")
    if not base:
        base = "output"
    return f"{base[:MAX_BASE_LENGTH]}.{ext}"


def _ordered(table: Table, single_file: bool = False, extra=()) -> DataFrame:
    """Rows in table order.  Many parts: a range-partitioned global sort
    (part files follow partition order).  One file: all rows go to one task
    and are sorted there, since ``coalesce`` does not keep partition order."""
    table.validate(carried=False)
    keys = [k.column() for k in table.order]
    cols = [C(c) for c in table.columns] + list(extra)
    if single_file:
        # only the write runs in one task: what comes before keeps its own parallelism
        df = table.df.repartition(1)
        if keys:
            df = df.sortWithinPartitions(*keys)
        return df.select(*cols)
    df = table.df.orderBy(*keys) if keys else table.df
    return df.select(*cols)


@contextlib.contextmanager
def _output(table: Table, path: str, single_file: bool, mode: str):
    """The folder to write to.  One file, or rows that may still fail a check: a folder beside ``path``, whose
    files take the place of ``path`` at the end."""
    beside = single_file or (bool(table.carried) and mode == "overwrite")
    target = f"{path}.__parts" if beside else path
    try:
        with table.explained():
            yield target
    except Exception:
        if beside:
            fs, src = _file_system(table, target)
            fs.delete(src, True)
        raise
    if beside:
        fs, src = _file_system(table, target)
        dst = _file_system(table, path)[1]
        if fs.exists(dst):
            fs.delete(dst, True)
        if not single_file:
            fs.rename(src, dst)
            return
        parts = [s.getPath() for s in fs.listStatus(src) if s.getPath().getName().startswith("part-")]
        if parts:
            fs.rename(parts[0], dst)
        else:
            fs.create(dst).close()
        fs.delete(src, True)


def _file_system(table: Table, path: str) -> tuple:
    spark = table.df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


# -- K1 ------------------------------------------------------------------------------

def csv_cell(col: Column, dtype: T.DataType, delimiter: str) -> Column:
    text = F.coalesce(S.text_form(col, dtype), F.lit(""))
    needs = text.contains(delimiter) | text.contains('"') | text.contains("\r") | text.contains("\n")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_text(value: str, delimiter: str) -> str:
    if any(ch in value for ch in (delimiter, '"', "\r", "\n")):
        return '"' + value.replace('"', '""') + '"'
    return value


def csv_lines(table, delimiter: str = ",", single_file: bool = False) -> DataFrame:
    """One text row per table row, in table order (no header)."""
    table = as_table(table)
    df = _ordered(table, single_file)
    cells = [csv_cell(C(c), table.dtype(c), delimiter) for c in table.columns]
    if len(cells) == 1:
        # an empty line would be no row at all to a reader
        cells = [F.when(cells[0] == "", F.lit('""')).otherwise(cells[0])]
    return df.select(F.concat_ws(delimiter, *cells).alias("value"))


def _counted(df: DataFrame, rows: Column) -> tuple[DataFrame, Observation]:
    """Row count gathered by the write itself.  It stands above the sort: below it, a sort's
    sampling pass would count rows a second time."""
    seen = Observation()
    return df.observe(seen, F.count_if(rows).alias("rows")), seen


def _with_header(lines: DataFrame, header_line: str) -> DataFrame:
    """(value, is_row): the header row before the rows of each partition.

    The first row of a partition is the one whose generated id has no row bits."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    row, head = F.struct("value", F.lit(True).alias("is_row")), F.struct(F.lit(header_line).alias("value"), F.lit(False).alias("is_row"))
    marked = lines.withColumn("first", first)
    return marked.select(F.explode(F.when(F.col("first"), F.array(head, row)).otherwise(F.array(row))).alias("r")).select("r.*")


def write_csv(table, path: str, delimiter: str = ",", header: bool = True, single_file: bool = False,
              mode: str = "overwrite") -> int:
    """Write CSV, return the number of rows; with ``header`` every part file starts with the header row."""
    from ..sources.text import resolve_delimiter
    table = as_table(table)
    delimiter = resolve_delimiter(delimiter) or ","
    lines = csv_lines(table, delimiter, single_file)
    spark = lines.sparkSession
    header_line = delimiter.join(csv_text(c, delimiter) for c in table.columns)
    out = _with_header(lines, header_line) if header else lines.withColumn("is_row", F.lit(True))
    out, seen = _counted(out, F.col("is_row"))
    with _output(table, path, single_file, mode) as target:
        out.select("value").write.mode(mode).option("lineSep", "\r\n").text(target)
        rows = seen.get["rows"]
        if header and not rows:  # no partition had a first row to put the header before
            spark.createDataFrame([(header_line,)], "value string").coalesce(1).write.mode(mode).option("lineSep", "\r\n").text(target)
    return rows


# -- K2 ------------------------------------------------------------------------------

def _json_value(col: Column, dtype: T.DataType, bigint_as_text: bool) -> Column:
    """Value that to_json writes the way a cell is to be written (all but numbers with a fraction)."""
    if isinstance(dtype, T.LongType) and bigint_as_text:
        return col.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return S.iso_millis(col)
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    return col


def _json_number(col: Column) -> Column:
    """JSON text of a number as JavaScript writes it (1, not 1.0); ``null`` for null, NaN and infinities."""
    d = col.cast("double")
    finite = ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(finite, S.js_number_text(d)).otherwise(F.lit("null"))


def jsonl_lines(table, bigint_as_text: bool = False, single_file: bool = False) -> DataFrame:
    """One JSON object per row: neighbouring columns by one ``to_json``, numbers with a fraction as their text between them."""
    table = as_table(table)
    df = _ordered(table, single_file)
    pieces, run = [], []

    def close_run():
        if run:
            text = F.to_json(F.struct(*run), {"ignoreNullFields": "false"})
            pieces.append(F.substring(text, F.lit(2), F.length(text) - 2))
            run.clear()

    for c in table.columns:
        dtype = table.dtype(c)
        if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
            close_run()
            pieces.append(F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ":"), _json_number(C(c))))
        else:
            run.append(_json_value(C(c), dtype, bigint_as_text).alias(c))
    close_run()
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")).alias("value"))


def write_jsonl(table, path: str, single_file: bool = False, bigint_as_text: bool = False,
                mode: str = "overwrite") -> int:
    """Write JSON Lines, return the number of rows: columns in table order, nulls written, timestamps
    ISO-8601 UTC with milliseconds, NaN/Infinity as null."""
    table = as_table(table)
    out, seen = _counted(jsonl_lines(table, bigint_as_text, single_file), F.lit(True))
    with _output(table, path, single_file, mode) as target:
        out.write.mode(mode).option("lineSep", "\n").text(target)
    return seen.get["rows"]


# -- K3 ------------------------------------------------------------------------------

def write_parquet(table, path: str, single_file: bool = False, legacy_types: bool = False,
                  mode: str = "overwrite") -> int:
    """Write Snappy Parquet, return the number of rows.  Native Spark types are kept; ``legacy_types``
    narrows to boolean / int32 / double / text (integers that do not fit
    int32 become double, dates and nested values become text)."""
    table = as_table(table)
    names = table.columns
    require_distinct(names, "COLUMN_NAME_COLLISION", "The output column")
    df = _ordered(table, single_file)
    cols = []
    fits = {}
    if legacy_types:
        ints = [c for c in names if isinstance(table.dtype(c), S.INTEGRAL_TYPES)]
        if ints:
            with table.explained():
                row = df.agg(*[F.coalesce(F.max(F.abs(C(c).cast("double"))), F.lit(0.0)).alias(f"m{i}")
                               for i, c in enumerate(ints)]).collect()[0]
            fits = {c: row[f"m{i}"] <= 2 ** 31 - 1 for i, c in enumerate(ints)}
    for c in names:
        dt = table.dtype(c)
        if isinstance(dt, T.NullType):
            cols.append(F.lit(None).cast("string").alias(c))
        elif legacy_types:
            if isinstance(dt, T.BooleanType):
                cols.append(C(c))
            elif isinstance(dt, S.INTEGRAL_TYPES):
                cols.append(C(c).cast("int" if fits.get(c) else "double").alias(c))
            elif isinstance(dt, S.FRACTIONAL_TYPES):
                cols.append(C(c).cast("double").alias(c))
            else:
                cols.append(S.text_form(C(c), dt).alias(c))
        else:
            cols.append(C(c))
    out, seen = _counted(df.select(*cols), F.lit(True))
    with _output(table, path, single_file, mode) as target:
        out.write.mode(mode).option("compression", "snappy").parquet(target)
    return seen.get["rows"]
