"""Parquet source (S4) with the flat-table contract and optional row order."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError
from ..table import C, OrderKey, Table, hidden_name, spread


#: Bits of a row's place that number the rows of one file.
ROW_BITS = 40


def nested_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]


def file_order(df, name: str):
    """Adds ``name``, a BIGINT that increases with (file path, row in the file).

    Files are numbered in path order (Spark lists them on the driver anyway);
    the number takes the high bits, the row index the low ROW_BITS bits."""
    row = F.col("_metadata.row_index").cast("long")
    files = sorted({re.sub("^file:/+", "file:/", f) for f in df.inputFiles()})
    if len(files) <= 1:
        return df.withColumn(name, row)
    path, number = hidden_name("path"), hidden_name("number")
    listed = df.sparkSession.createDataFrame(list(enumerate(files)), f"{number} long, {path} string")
    at = df.select("*", F.col("_metadata.file_path").alias(path), row.alias(name))
    joined = at.join(listed, path, "left")  # one row per file; Spark broadcasts it if it is small
    place = F.shiftleft(F.coalesce(C(number), F.lit(0)), ROW_BITS) + C(name)
    return joined.select(*[C(c) for c in df.columns], place.alias(name))


def _footer_fields(spark: SparkSession, df) -> dict:
    """{column: its Parquet type as text} from the footer of one file."""
    jvm = spark._jvm
    footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(
        spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]))
    return {f.getName(): f.toString() for f in footer.getFileMetaData().getSchema().getFields()}


def _as_read(df, spark, kinds_of):
    """Bytes as tables show them: BYTE_ARRAY as UTF-8 text, UUIDs as dashed hex, other fixed bytes as hex."""
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    if not binary:
        return df
    kinds = _footer_fields(spark, kinds_of)
    cols = []
    for c in df.columns:
        kind = kinds.get(c, "")
        if c not in binary:
            cols.append(C(c))
        elif "fixed_len_byte_array" not in kind:
            cols.append(F.decode(C(c), "UTF-8").alias(c))
        else:
            text = F.lower(F.hex(C(c)))
            if "UUID" in kind:
                text = F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
            cols.append(text.alias(c))
    return df.select(*cols)


def read_parquet(spark: SparkSession, path, flat_only: bool = True, keep_order: bool = False,
                 limit: int | None = None, rebalance: int = 0) -> Table:
    """Read Parquet files as a Table.

    ``flat_only`` rejects nested or repeated columns (``PARQUET_NESTED``), as
    pipelines only handle flat tables.  Untyped BYTE_ARRAY columns are read as
    UTF-8 text, UUIDs as dashed hex, other fixed bytes as hex, and nanosecond timestamps cut to microseconds.  ``keep_order``
    carries the file order as one BIGINT; it costs nothing until an operator
    needs it.  ``limit`` reads only the first rows (Spark pushes the limit into
    the scan).  ``rebalance`` deals the rows to that many tasks (a full
    shuffle; for one small file with costly per-row work)."""
    paths = [path] if isinstance(path, str) else path
    try:
        df = spark.read.parquet(*paths)
    except AnalysisException as exc:
        if "NANOS" not in str(exc):
            raise
        df = _nanos_as_timestamps(spark, paths)
    if flat_only:
        nested = nested_columns(df.schema)
        if nested:
            raise TableError("PARQUET_NESTED", f"Columns with nested values can't be read flat: {', '.join(nested)}.",
                             columns=nested)
    order = ()
    names, source = df.columns, df
    if keep_order:
        place = hidden_name("place")
        df = file_order(df, place)
        order = (OrderKey(place),)
    if rebalance and limit is None:
        df = spread(df, F.xxhash64(*[C(c) for c in names]), rebalance)
    table = Table(_as_read(df, spark, source), order)
    if limit is not None:
        from ..operators.rows import limit_rows
        table = limit_rows(table, limit)
    return table


def _nanos_as_timestamps(spark: SparkSession, paths):
    """Files with TIMESTAMP(NANOS): Spark reads those as BIGINT under a setting; cut to microseconds here.

    One file's footer says which columns they are."""
    setting = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df = spark.read.parquet(*paths)
    finally:
        spark.conf.set(setting, before)
    nanos = {c for c, kind in _footer_fields(spark, df).items() if "TIMESTAMP(NANOS" in kind}
    return df.select(*[F.timestamp_micros(F.expr(f"`{c}` div 1000")).alias(c) if c in nanos else C(c) for c in df.columns])
