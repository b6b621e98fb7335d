"""Profiles of wide tables: text cells are classified by one expression."""

from conftest import make_table
from pyspark.sql import functions as F

from tablewright.functions import sniff as S
from tablewright.operators.profile import infer_schema
from tablewright.table import Table

ODD_CELLS = ["", " ", " ", "﻿", "​", "0", "-0", "00", "+7", "+", "-", ".", "1.", ".5", "-.5", "01", "01.5", "0.5", "1e5", "1E-5", "123e-5", "123e-x", "1,5", "/1", " 12 ", "\t12", "12　",
             " 12.5", "12\u0085", "12​", "0x10", "1d", "1f", "NaN", "Infinity", "9" * 40, "1e400", "١٢", "true", " TRUE ", "False", "tru", "truee", "F", "T", "t", "Key", "g", "e5", "2024-02-29",
             "2023-02-29", "2024-2-29", "2024-02-29 ", "2024-1-01T1", "2024-01-1T", "2024-01-1\x01", "2024-01-01\u0085", "0099-01-01", "0100-01-01", "2024-13-01", "2024-01-01T10:00", "2024-01-01 10:00:00.5Z",
             "2024-01-01t10:00:60", "2024-01-01T29:00", "2024-01-01T10:00+0530", "2024-02-30 10:00", "\x7f1", "1\x7f", "é1", "1é", "~", "!", "\x00", "1\n", "1\n2", "true\u0085", "\U0001f600"]


def test_cells_keep_their_classes_in_profiles(spark):
    cells = make_table(spark, [(c,) for c in [*ODD_CELLS, None]], "c string", False).df
    labels = {k: i for i, k in enumerate(("none", *S.CLASSES))}
    rows = cells.select("c", S.text_class(F.col("c"), labels).alias("plain"), S.visible_trim(F.col("c")).alias("t"), S.js_trim(F.col("c")).alias("trimmed")) \
        .withColumn("fast", S.trimmed_class(F.col("t"), labels)).collect()
    assert [r["c"] for r in rows if (r["plain"], r["trimmed"]) != (r["fast"], r["t"])] == []
    assert len({r["fast"] for r in rows}) == 8  # null and all classes of text, none among them


def test_wide_text_tables_use_one_class_expression(spark):
    """One class expression per text column made methods that the JIT compiler leaves out."""
    def patterns(columns):
        df = infer_schema(Table(spark.range(3).select(*[F.concat(F.lit("x"), "id").alias(f"c{i}") for i in range(columns)])))
        return df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert 0 < patterns(25) == patterns(1)


def test_mixed_wide_table_keeps_positions(spark):
    cols = [F.lit("2024-01-01").alias("d"), F.col("id").alias("i"), F.lit(" ").alias("b"), (F.col("id") + 0.5).alias("n"), F.lit("").alias("e"), F.lit(None).cast("string").alias("z")]
    rows = infer_schema(Table(spark.range(4).select(*[c.alias(f"{k}{j}") for k in range(15) for j, c in enumerate(cols)]))).orderBy("position").collect()
    assert [(r["position"], r["name"]) for r in rows] == [(6 * k + j, f"{k}{j}") for k in range(15) for j in range(6)]
    assert [(r["type"], r["nullCount"], r["emptyCount"], r["observedCount"]) for r in rows] == 15 * [
        ("date", 0, 0, 4), ("integer", 0, 0, 4), ("string", 0, 0, 4), ("number", 0, 0, 4), ("string", 0, 4, 0), ("string", 4, 0, 0)]
