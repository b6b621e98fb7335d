"""Queries over the TESTDATA tables, one or more per operator, each with an
equivalent DuckDB SQL text used as the correctness oracle.

Every query reads whole tables (or tables Spark derives from them) and is
built from the library's operators.  Ordered results expose their order as a
``rank`` column (1..n, computed without a single-partition step, see
``plans.rank``) because results are compared order-insensitively.  Doubles
that are sums or averages are rounded to 2 places on both sides.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import group_by
from ..operators.columns import cast_columns, clean_text, rename_columns, select_columns
from ..operators.combine import join_tables, union_tables
from ..operators.profile import infer_schema, preview, type_census
from ..operators.rows import deduplicate_rows, filter_rows, handle_nulls, limit_rows, sort_rows
from ..session import scratch_path
from ..sinks.files import write_csv, write_jsonl, write_parquet
from ..sources.parquet import read_parquet
from ..sources.text import csv_rejects, jsonl_rejects, read_csv, read_jsonl
from ..table import Table
from .pipeline import (evaluate_node, input_nodes, make_recipe, normalize_recipes, parse_pipeline, preview_node, run_pipeline,
                       stringify_pipeline)
from .rank import with_rank


def load(spark: SparkSession, sf_dir: str, name: str, keep_order: bool = False) -> Table:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", flat_only=(name != "embeddings"), keep_order=keep_order)


def _round(df: DataFrame, cols, places: int = 2) -> DataFrame:
    return df.select(*[F.round(F.col(c), places).alias(c) if c in cols else F.col(c) for c in df.columns])


def rule(column, operator, value=None):
    r = {"column": column, "operator": operator}
    if operator not in ("is-null", "not-null"):
        r["value"] = value
    return r


def agg(operation, column, alias):
    return {"operation": operation, "column": column, "as": alias}


# -- one real query (S4, F6, G1, A1-A3, O-1) ---------------------------------------

def pricing_summary(spark, d):
    li = select_columns(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate"])
    f = filter_rows(li, [rule("l_shipdate", "lte", "1998-09-02")])
    g = group_by(f, ["l_returnflag", "l_linestatus"], [
        agg("count", "*", "count_order"), agg("sum", "l_quantity", "sum_qty"),
        agg("sum", "l_extendedprice", "sum_base_price"), agg("average", "l_quantity", "avg_qty"),
        agg("average", "l_extendedprice", "avg_price")])
    s = sort_rows(g, [{"column": "l_returnflag"}, {"column": "l_linestatus"}])
    return _round(with_rank(s), ["sum_qty", "sum_base_price", "avg_qty", "avg_price"])


PRICING_SUMMARY_SQL = """
SELECT l_returnflag, l_linestatus, count(*) AS count_order,
       round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(avg(l_quantity), 2) AS avg_qty, round(avg(l_extendedprice), 2) AS avg_price,
       row_number() OVER (ORDER BY l_returnflag, l_linestatus) AS rank
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'
GROUP BY l_returnflag, l_linestatus
"""


# -- flagship: star join, filter, group, top 10 --------------------------------------

def shipping_top10(spark, d):
    cust = filter_rows(select_columns(load(spark, d, "customer"), ["c_custkey", "c_mktsegment"]),
                       [rule("c_mktsegment", "eq", "BUILDING")])
    orders = filter_rows(select_columns(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]),
                         [rule("o_orderdate", "lt", "1995-03-15")])
    li = filter_rows(select_columns(load(spark, d, "lineitem"), ["l_orderkey", "l_extendedprice", "l_shipdate"]),
                     [rule("l_shipdate", "gt", "1995-03-15")])
    co = join_tables(cust, orders, "inner", [{"left": "c_custkey", "right": "o_custkey"}])
    col = join_tables(co, li, "inner", [{"left": "o_orderkey", "right": "l_orderkey"}])
    g = group_by(col, ["l_orderkey", "o_orderdate", "o_orderpriority"], [agg("sum", "l_extendedprice", "revenue")])
    top = limit_rows(sort_rows(g, [{"column": "revenue", "direction": "desc"}, {"column": "l_orderkey"}]), 10)
    return _round(with_rank(top), ["revenue"])


SHIPPING_TOP10_SQL = """
SELECT l_orderkey, o_orderdate, o_orderpriority, round(revenue, 2) AS revenue,
       row_number() OVER (ORDER BY revenue DESC, l_orderkey) AS rank
FROM (
  SELECT l_orderkey, o_orderdate, o_orderpriority, sum(l_extendedprice) AS revenue
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
  GROUP BY l_orderkey, o_orderdate, o_orderpriority
) ORDER BY revenue DESC, l_orderkey LIMIT 10
"""


# -- C1, C2 ------------------------------------------------------------------------------

def q_select_rename(spark, d):
    t = select_columns(load(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    t = rename_columns(t, [{"from": "c_name", "to": "name"}, {"from": "c_nationkey", "to": "c_mktsegment"},
                           {"from": "c_mktsegment", "to": "c_nationkey"}])
    return t.to_df()


# -- C3, C4 ----------------------------------------------------------------------------------

def q_clean_text(spark, d):
    part = load(spark, d, "part").df
    padded = Table(part.select("p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t")).alias("key")))
    return clean_text(padded, ["key"], trim=True, case_mode="lowercase").to_df()


# -- C5..C11 -------------------------------------------------------------------------------

def q_cast_modes(spark, d):
    o = load(spark, d, "orders").df
    text = Table(o.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("key_txt"),
        F.col("o_totalprice").cast("string").alias("price_txt"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_txt"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ts_txt"),
        F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "off").otherwise("maybe").alias("flag_txt"),
    ))
    strict = cast_columns(text, [{"column": "key_txt", "type": "integer"}, {"column": "price_txt", "type": "number"},
                                 {"column": "date_txt", "type": "date"}, {"column": "ts_txt", "type": "timestamp"}], "error")
    out = cast_columns(strict, [{"column": "flag_txt", "type": "boolean"}], "null").to_df()
    return out.withColumn("ts_txt", F.col("ts_txt").cast("timestamp_ntz"))


CAST_MODES_SQL = """
SELECT o_orderkey, o_orderkey AS key_txt, o_totalprice AS price_txt, CAST(o_orderdate AS DATE) AS date_txt,
       o_orderdate AS ts_txt,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false ELSE NULL END AS flag_txt
FROM orders
"""


# -- F1..F13 ------------------------------------------------------------------------------------

def q_filter_and(spark, d):
    li = select_columns(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"])
    return filter_rows(li, [rule("l_quantity", "gt", 30), rule("l_returnflag", "eq", "R"),
                            rule("l_shipdate", "lt", "1995-06-01")], "and").to_df()


def q_filter_or(spark, d):
    p = select_columns(load(spark, d, "part"), ["p_partkey", "p_name", "p_brand", "p_type"])
    return filter_rows(p, [rule("p_brand", "ends-with", "#13"), rule("p_name", "starts-with", "red"),
                           rule("p_type", "contains", "PROMO")], "or").to_df()


def q_filter_range(spark, d):
    o = select_columns(load(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderpriority"])
    return filter_rows(o, [rule("o_totalprice", "gte", "100000"), rule("o_totalprice", "lte", 200000),
                           rule("o_orderpriority", "neq", "5-LOW")], "and").to_df()


def _events_with_nulls(spark, d) -> Table:
    e = load(spark, d, "events").df
    return Table(e.select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"), "value"))


def q_filter_null(spark, d):
    return select_columns(filter_rows(_events_with_nulls(spark, d), [rule("event_type", "is-null")]),
                          ["event_id", "event_type"]).to_df()


def q_filter_not_null(spark, d):
    return select_columns(filter_rows(_events_with_nulls(spark, d), [rule("event_type", "not-null")]),
                          ["event_id", "event_type"]).to_df()


def q_null_remove(spark, d):
    return select_columns(handle_nulls(_events_with_nulls(spark, d), "remove", ["event_type"]),
                          ["event_id", "event_type"]).to_df()


def q_null_replace(spark, d):
    return select_columns(handle_nulls(_events_with_nulls(spark, d), "replace", ["event_type"], "unknown"),
                          ["event_id", "event_type"]).to_df()


# -- O-1..O-5 ------------------------------------------------------------------------------------

def q_sort_multi(spark, d):
    li = load(spark, d, "lineitem").df
    t = Table(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                        "l_returnflag", F.nullif(F.col("l_linestatus"), F.lit("O")).alias("status")))
    s = sort_rows(t, [{"column": "l_returnflag"}, {"column": "status", "direction": "desc"},
                      {"column": "l_quantity", "direction": "desc"}, {"column": "l_orderkey"},
                      {"column": "l_linenumber"}, {"column": "l_partkey"}, {"column": "l_suppkey"},
                      {"column": "l_extendedprice"}])
    return with_rank(select_columns(s, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status"]))


SORT_MULTI_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NULLIF(l_linestatus, 'O') AS status,
       row_number() OVER (ORDER BY l_returnflag ASC NULLS LAST, NULLIF(l_linestatus, 'O') DESC NULLS LAST,
                          l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank
FROM lineitem
"""


def q_limit_n(spark, d):
    o = select_columns(load(spark, d, "orders", keep_order=True), ["o_orderkey", "o_custkey"])
    return limit_rows(o, 10).to_df()


def q_top_k(spark, d):
    o = select_columns(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    top = limit_rows(sort_rows(o, [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}]), 10)
    return with_rank(top)


def q_natural_sort(spark, d):
    brands = deduplicate_rows(select_columns(load(spark, d, "part"), ["p_brand"]))
    return with_rank(sort_rows(brands, [{"column": "p_brand"}]))


# -- D1, D2 -----------------------------------------------------------------------------------------

def q_dedup_all(spark, d):
    return deduplicate_rows(select_columns(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])).to_df()


def q_dedup_keys(spark, d):
    docs = sort_rows(load(spark, d, "documents"), [{"column": "doc_id"}])
    return select_columns(deduplicate_rows(docs, ["text"]), ["doc_id", "lang", "source", "n_chars"]).to_df(ordered=False)


# -- J1..J9 -------------------------------------------------------------------------------------------

def _join_sides(spark, d):
    cust = filter_rows(select_columns(load(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"]),
                       [rule("c_nationkey", "lte", 12)])
    march = filter_rows(select_columns(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]),
                        [rule("o_orderdate", "gte", "1995-03-01"), rule("o_orderdate", "lt", "1995-04-01")])
    return cust, select_columns(march, ["o_orderkey", "o_custkey", "o_totalprice"])


def _join_query(how):
    def run(spark, d):
        cust, march = _join_sides(spark, d)
        return join_tables(cust, march, how, [{"left": "c_custkey", "right": "o_custkey"}]).to_df(ordered=False)
    return run


def _join_sql(how):
    return f"""
SELECT c_custkey, c_name, c_nationkey, o_orderkey, o_custkey, o_totalprice
FROM (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey <= 12) c
{how} JOIN (SELECT o_orderkey, o_custkey, o_totalprice FROM orders
            WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01') o
ON c.c_custkey = o.o_custkey
"""


def q_join_multi_key(spark, d):
    left = select_columns(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    right = filter_rows(select_columns(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"]),
                        [rule("o_orderdate", "gte", "1995-03-01"), rule("o_orderdate", "lt", "1995-04-01")])
    return join_tables(left, right, "inner", [{"left": "o_orderkey", "right": "o_orderkey"},
                                               {"left": "o_custkey", "right": "o_custkey"}]).to_df(ordered=False)


JOIN_MULTI_KEY_SQL = """
SELECT a.o_orderkey, a.o_custkey, a.o_totalprice, b.o_orderkey AS o_orderkey_right,
       b.o_custkey AS o_custkey_right, b.o_orderdate
FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey
WHERE b.o_orderdate >= TIMESTAMP '1995-03-01' AND b.o_orderdate < TIMESTAMP '1995-04-01'
"""


def _strict_sides(spark, d):
    o = load(spark, d, "orders").df
    left = Table(o.select("o_orderkey", "o_custkey"))
    right = Table(o.select(F.col("o_orderkey").cast("string").alias("key_txt"), "o_orderstatus"))
    return left, right


def q_join_strict_types(spark, d):
    """One key pair fits, the other is number against text: no row matches, both sides stay whole."""
    left, _ = _strict_sides(spark, d)
    c = load(spark, d, "customer").df
    right = Table(c.select("c_custkey", F.col("c_custkey").cast("string").alias("key_txt")))
    keys = [{"left": "o_custkey", "right": "c_custkey"}, {"left": "o_orderkey", "right": "key_txt"}]
    both = join_tables(left, right, "full", keys).to_df(ordered=False)
    return both.groupBy(F.col("o_orderkey").isNull().alias("right_only")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("key_txt").alias("keys"), F.sum("o_custkey").alias("cust_sum"))


def q_join_strict_left(spark, d):
    left, right = _strict_sides(spark, d)
    return join_tables(left, right, "left", [{"left": "o_orderkey", "right": "key_txt"}]).to_df(ordered=False)


# -- U1..U4 ----------------------------------------------------------------------------------------------

def q_union_name(spark, d):
    c = rename_columns(select_columns(load(spark, d, "customer"), ["c_custkey", "c_name", "c_acctbal"]),
                       [{"from": "c_custkey", "to": "id"}, {"from": "c_name", "to": "name"}, {"from": "c_acctbal", "to": "balance"}])
    s = rename_columns(select_columns(load(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"]),
                       [{"from": "s_suppkey", "to": "id"}, {"from": "s_name", "to": "name"}, {"from": "s_nationkey", "to": "nation"}])
    return union_tables([c, s], mode="name").to_df(ordered=False)


UNION_NAME_SQL = """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL
SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS DOUBLE) AS balance, s_nationkey AS nation FROM supplier
"""


def q_union_position(spark, d):
    c = select_columns(load(spark, d, "customer"), ["c_custkey", "c_name"])
    s = select_columns(load(spark, d, "supplier"), ["s_suppkey", "s_name"])
    return union_tables([c, s], mode="position").to_df(ordered=False)


# -- G1, G2, A1..A7 --------------------------------------------------------------------------------------

def q_group_multi(spark, d):
    li = load(spark, d, "lineitem")
    g = group_by(li, ["l_returnflag", "l_linestatus"], [
        agg("count", "*", "n"), agg("sum", "l_quantity", "sum_qty"), agg("avg", "l_extendedprice", "avg_price"),
        agg("min", "l_discount", "min_disc"), agg("max", "l_tax", "max_tax")])
    return _round(g.to_df(ordered=False), ["sum_qty", "avg_price"])


def q_group_global(spark, d):
    g = group_by(load(spark, d, "lineitem"), [], [
        agg("count", "*", "n"), agg("sum", "l_quantity", "sum_qty"), agg("average", "l_discount", "avg_disc"),
        agg("min", "l_shipdate", "first_ship"), agg("max", "l_shipdate", "last_ship")])
    return _round(g.to_df(ordered=False), ["sum_qty", "avg_disc"], 4)


def q_group_empty(spark, d):
    none = filter_rows(load(spark, d, "lineitem"), [rule("l_quantity", "gt", 1000)])
    return group_by(none, [], [agg("count", "*", "n"), agg("sum", "l_quantity", "sum_qty")]).to_df(ordered=False)


def q_min_max_text(spark, d):
    g = group_by(load(spark, d, "part"), ["p_type"], [agg("min", "p_brand", "min_brand"), agg("max", "p_brand", "max_brand")])
    return g.to_df(ordered=False)


def q_group_text_sum(spark, d):
    """Sum and average over numbers stored as text (A2, A3 on text)."""
    o = load(spark, d, "orders").df
    t = Table(o.select("o_orderpriority", F.col("o_totalprice").cast("string").alias("price_txt")))
    g = group_by(t, ["o_orderpriority"], [agg("sum", "price_txt", "total"), agg("average", "price_txt", "mean"),
                                           agg("min", "price_txt", "low"), agg("max", "price_txt", "high")])
    out = g.to_df(ordered=False)
    return _round(out, ["total", "mean"]).select("o_orderpriority", "total", "mean",
                                                 F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


# -- P1..P3 ---------------------------------------------------------------------------------------------

def _profiled_orders(spark, d) -> Table:
    o = load(spark, d, "orders").df
    return Table(o.select(
        F.col("o_orderkey").cast("string").alias("key_txt"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit("")).otherwise(F.col("o_orderpriority")).alias("prio"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("false").alias("flag"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("mixed"),
        "o_totalprice",
    ))


def q_profile(spark, d):
    return infer_schema(_profiled_orders(spark, d))


def q_type_census(spark, d):
    return type_census(_profiled_orders(spark, d))


_PROFILED_SQL = """
WITH p AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS key_txt, NULLIF(o_orderstatus, 'P') AS status,
         CASE WHEN starts_with(o_orderpriority, '1') THEN '' ELSE o_orderpriority END AS prio,
         strftime(o_orderdate, '%Y-%m-%d') AS day,
         CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'false' END AS flag,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed,
         o_totalprice
  FROM orders
), cells AS (
  SELECT 0 AS position, 'key_txt' AS name, key_txt AS v, NULL AS cls FROM p UNION ALL
  SELECT 1, 'status', status, NULL FROM p UNION ALL
  SELECT 2, 'prio', prio, NULL FROM p UNION ALL
  SELECT 3, 'day', day, NULL FROM p UNION ALL
  SELECT 4, 'flag', flag, NULL FROM p UNION ALL
  SELECT 5, 'mixed', mixed, NULL FROM p UNION ALL
  SELECT 6, 'o_totalprice', CAST(o_totalprice AS VARCHAR),
         CASE WHEN o_totalprice = floor(o_totalprice) THEN 'integer' ELSE 'number' END FROM p
), classed AS (
  SELECT position, name, v, COALESCE(cls, CASE
      WHEN v IS NULL THEN NULL
      WHEN trim(v) = '' THEN 'none'
      WHEN regexp_full_match(trim(v), '(?i)(true|false)') THEN 'boolean'
      WHEN regexp_full_match(trim(v), '\\d{4}-\\d{2}-\\d{2}') AND try_cast(trim(v) AS DATE) IS NOT NULL THEN 'date'
      WHEN regexp_full_match(trim(v), '[+-]?(0|[1-9]\\d*)') THEN 'integer'
      ELSE 'string' END) AS cls
  FROM cells
)
"""

PROFILE_SQL = _PROFILED_SQL + """
SELECT CAST(position AS INTEGER) AS position, name,
  CASE WHEN count(DISTINCT cls) FILTER (WHERE cls <> 'none') = 0 THEN 'string'
       WHEN count(DISTINCT cls) FILTER (WHERE cls <> 'none') = 1 THEN max(cls) FILTER (WHERE cls <> 'none')
       WHEN bool_and(cls IN ('integer', 'number')) FILTER (WHERE cls <> 'none') THEN 'number'
       WHEN bool_and(cls IN ('date', 'timestamp')) FILTER (WHERE cls <> 'none') THEN 'timestamp'
       ELSE 'mixed' END AS type,
  count(*) FILTER (WHERE v IS NULL) > 0 AS nullable,
  count(*) FILTER (WHERE v IS NULL) AS nullCount,
  count(*) FILTER (WHERE v = '') AS emptyCount,
  count(*) FILTER (WHERE v IS NOT NULL AND v <> '') AS observedCount
FROM classed GROUP BY position, name
"""

TYPE_CENSUS_SQL = _PROFILED_SQL + """
SELECT name AS column_name, cell_class, count(*) AS rows FROM (
  SELECT name, CASE WHEN v IS NULL THEN 'null' WHEN v = '' THEN 'empty' WHEN cls = 'none' THEN 'blank' ELSE cls END AS cell_class
  FROM classed
) GROUP BY name, cell_class
"""


def q_preview(spark, d):
    o = load(spark, d, "orders").df
    t = Table(o.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_totalprice", "o_orderdate"))
    return preview(sort_rows(t, [{"column": "o_orderkey"}]), 100)


PREVIEW_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, COALESCE(NULLIF(o_orderstatus, 'P'), 'NULL') AS status,
       CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
            ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS o_orderdate
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)
"""


# -- S1, S2, K1: CSV round trip and a folder of mixed delimiters ---------------------------------

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _customer_back(t: Table) -> DataFrame:
    typed = cast_columns(t, [{"column": "c_custkey", "type": "integer"}, {"column": "c_nationkey", "type": "integer"},
                             {"column": "c_acctbal", "type": "number"}], "error")
    df = typed.validate(carried=False).to_df(ordered=False)
    return df.select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


def q_csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    write_csv(select_columns(load(spark, d, "customer"), CUSTOMER_COLS), path)
    return _customer_back(read_csv(spark, path, delimiter="comma", carry=True))


def q_delimiter_folder(spark, d):
    cust = select_columns(load(spark, d, "customer"), CUSTOMER_COLS)
    root = scratch_path(spark, "mixed")
    paths = []
    for name, delim in (("comma", ","), ("tab", "\t"), ("pipe", "|")):
        paths.append(os.path.join(root, name))
        write_csv(cust, paths[-1], delimiter=delim)
    return _customer_back(read_csv(spark, paths, delimiter="auto", carry=True))


DELIMITER_FOLDER_SQL = " UNION ALL ".join(
    ["SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"] * 3)


# -- S3, K2: JSONL round trip and key discovery ------------------------------------------------

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def q_jsonl_round_trip(spark, d):
    path = scratch_path(spark, "jsonl")
    write_jsonl(select_columns(load(spark, d, "orders"), ORDER_COLS), path)
    back = read_jsonl(spark, path)
    typed = cast_columns(back, [{"column": "o_orderdate", "type": "timestamp"}], "error")
    return typed.to_df(ordered=False).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def _event_docs(spark, d) -> DataFrame:
    e = load(spark, d, "events").df
    doc = (F.when(F.col("event_type") == "click", F.to_json(F.struct(F.col("value").alias("k"), F.col("user_id").alias("u"))))
           .when(F.col("event_type") == "view", F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_id").alias("page"))))
           .otherwise(F.col("props")))
    return e.select("event_id", doc.alias("value"))


#: Keys of one text file that a query writes.
FILE_KEYS = 1 << 14


def _write_lines(df: DataFrame, order: str, path: str, header: str | None = None) -> str:
    """Text files in the order of a whole-number column, one per FILE_KEYS values of it (plain Spark writer)."""
    part = F.lpad(F.floor(F.col(order) / FILE_KEYS).cast("string"), 12, "0")
    rows = df.select(order, part.alias("part"), "value")
    if header is not None:
        rows = rows.unionByName(rows.select("part").distinct().select(F.lit(-1).cast(df.schema[order].dataType).alias(order), "part", F.lit(header).alias("value")))
    rows.repartition("part").sortWithinPartitions("part", order).select("part", "value").write.partitionBy("part").text(path)
    return path


def q_jsonl_columns(spark, d):
    """Columns of the JSONL reader in first-seen order (S3)."""
    path = _write_lines(_event_docs(spark, d), "event_id", scratch_path(spark, "jsonl-keys"))
    names = read_jsonl(spark, path).columns
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "key string, position int")


JSONL_COLUMNS_SQL = """
WITH j AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN json_object('k', value, 'u', user_id)
                                   WHEN 'view' THEN json_object('u', user_id, 'page', event_id)
                                   ELSE props END AS doc FROM events
), k AS (
  SELECT event_id, unnest(json_keys(doc)) AS key, unnest(range(len(json_keys(doc)))) AS pos FROM j
), f AS (SELECT key, min(event_id * 1000 + pos) AS first FROM k GROUP BY key)
SELECT key, row_number() OVER (ORDER BY first) AS position FROM f
"""


# -- K3: Parquet round trip ------------------------------------------------------------------------

def q_parquet_round_trip(spark, d):
    path = scratch_path(spark, "parquet")
    write_parquet(load(spark, d, "lineitem"), path)
    return read_parquet(spark, path).to_df(ordered=False)


# -- R1, R3, R5, R6: saved pipelines ---------------------------------------------------------------

def _node(node_id, kind, **data):
    return {"id": node_id, "type": kind, "position": {"x": 0, "y": 0}, "data": data}


def _edge(id, s, sp, t, tp):
    return {"id": id, "source": {"nodeId": s, "portId": sp}, "target": {"nodeId": t, "portId": tp}}


def revenue_graph() -> dict:
    """customer(BUILDING) x orders x lineitem -> revenue per order priority."""
    return {"nodes": [
        _node("customers", "parquet-input"), _node("orders", "parquet-input"), _node("items", "parquet-input"),
        _node("segment", "filter-rows", conditions=[rule("c_mktsegment", "eq", "BUILDING")], combination="and"),
        _node("co", "join", type="inner", keys=[{"left": "c_custkey", "right": "o_custkey"}]),
        _node("coi", "join", type="inner", keys=[{"left": "o_orderkey", "right": "l_orderkey"}]),
        _node("by_priority", "group-by", groups=["o_orderpriority"],
              aggregates=[agg("count", "*", "lines"), agg("sum", "l_extendedprice", "revenue")]),
        _node("sorted", "sort", keys=[{"column": "o_orderpriority", "direction": "asc"}]),
        _node("out", "parquet-output", filename="revenue"),
    ], "edges": [
        _edge("e1", "customers", "table", "segment", "in"), _edge("e2", "segment", "out", "co", "left"),
        _edge("e3", "orders", "table", "co", "right"), _edge("e4", "co", "out", "coi", "left"),
        _edge("e5", "items", "table", "coi", "right"), _edge("e6", "coi", "out", "by_priority", "in"),
        _edge("e7", "by_priority", "out", "sorted", "in"), _edge("e8", "sorted", "out", "out", "in"),
    ]}


def q_saved_run(spark, d):
    inputs = {"customers": f"{d}/customer.parquet", "orders": f"{d}/orders.parquet", "items": f"{d}/lineitem.parquet"}
    table = evaluate_node(spark, revenue_graph(), "sorted", inputs)
    return _round(with_rank(table), ["revenue"])


SAVED_RUN_SQL = """
SELECT o_orderpriority, count(*) AS lines, round(sum(l_extendedprice), 2) AS revenue,
       row_number() OVER (ORDER BY o_orderpriority) AS rank
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderpriority
"""


def segment_recipe_graph() -> dict:
    return {"nodes": [
        _node("customers", "parquet-input", fileName="customers-2025-01.parquet"),
        _node("clean", "clean-text", columns=["c_mktsegment"], trim=True, caseMode="lowercase"),
        _node("group", "group-by", groups=["c_mktsegment"],
              aggregates=[agg("count", "*", "n"), agg("average", "c_acctbal", "avg_bal")]),
        _node("out", "csv-output", filename="segments"),
    ], "edges": [_edge("e1", "customers", "table", "clean", "in"), _edge("e2", "clean", "out", "group", "in"),
                 _edge("e3", "group", "out", "out", "in")]}


def q_recipe_rebind(spark, d):
    recipe = make_recipe("Segments", parse_pipeline(stringify_pipeline(segment_recipe_graph(), "1")), now=0)
    restored = normalize_recipes(json.loads(json.dumps([recipe])))[0]
    bind = {n["id"]: f"{d}/customer.parquet" for n in input_nodes(restored["graph"])}
    table = evaluate_node(spark, restored["graph"], "group", bind)
    return _round(table.to_df(ordered=False), ["avg_bal"])


RECIPE_REBIND_SQL = """
SELECT lower(c_mktsegment) AS c_mktsegment, count(*) AS n, round(avg(c_acctbal), 2) AS avg_bal
FROM customer GROUP BY lower(c_mktsegment)
"""


# -- S1-S3a over files that plain Spark writers made -------------------------------------------------

def _orders_text(spark, d) -> DataFrame:
    return load(spark, d, "orders").df.select("o_orderkey", "o_custkey", "o_orderstatus")


def q_csv_mixed_headers(spark, d):
    """Files whose headers differ in order and width are united by name."""
    root, o = scratch_path(spark, "headers"), _orders_text(spark, d)
    o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey").write.csv(f"{root}/a", header=True)
    o.filter("o_orderkey % 2 = 1").select("o_custkey", "o_orderstatus", "o_orderkey").write.csv(f"{root}/b", header=True)
    t = read_csv(spark, [f"{root}/a", f"{root}/b"], carry=True)
    return t.to_df(ordered=False).select("o_orderkey", "o_custkey", "o_orderstatus")


CSV_MIXED_HEADERS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus FROM orders
"""


def q_csv_rejects(spark, d):
    """Rows with cells beyond the header and lines that end inside a quote."""
    o = _orders_text(spark, d)
    line = F.concat_ws(",", "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit("a,b"))
                       .when(F.col("o_orderkey") % 11 == 0, F.lit('"open')).when(F.col("o_orderkey") % 13 == 0, F.lit('"a,b"'))
                       .when(F.col("o_orderkey") % 17 == 0, F.lit('5" pipe')).otherwise(F.col("o_orderstatus")))
    path = _write_lines(o.select("o_orderkey", line.alias("value")), "o_orderkey", scratch_path(spark, "csv-rejects"), "o_orderkey,o_custkey,note")
    return csv_rejects(spark, path, delimiter="comma").select("reason", "text")


CSV_REJECTS_SQL = """
SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'CSV_ROW_WIDTH' ELSE 'CSV_OPEN_QUOTE' END AS reason,
       o_orderkey || ',' || o_custkey || ',' || CASE WHEN o_orderkey % 7 = 0 THEN 'a,b' ELSE '"open' END AS text
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0
"""


def q_csv_multiline(spark, d):
    """Quoted cells with newlines, delimiters and quotes (multi_line)."""
    c = load(spark, d, "customer").df
    path = scratch_path(spark, "csv-multiline")
    note = F.concat(F.col("c_name"), F.lit("\n"), F.lit('say "hi", '), F.col("c_mktsegment"))
    c.select("c_custkey", note.alias("note")).write.csv(path, header=True, escape='"')
    t = read_csv(spark, path, delimiter="comma", multi_line=True)
    t.validate()
    return cast_columns(t, [{"column": "c_custkey", "type": "integer"}], "null").to_df(ordered=False)


def q_jsonl_rejects(spark, d):
    """Lines that are no single object, with their line numbers."""
    o = _orders_text(spark, d)
    good = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    line = (F.when(F.col("o_orderkey") % 5 == 0, F.concat(good, F.lit(" trailing"))).when(F.col("o_orderkey") % 7 == 0, F.concat(good, good))
            .when(F.col("o_orderkey") % 11 == 0, F.lit("[1, 2]")).otherwise(good))
    path = _write_lines(o.select("o_orderkey", line.alias("value")), "o_orderkey", scratch_path(spark, "jsonl-rejects"))
    return jsonl_rejects(spark, path).select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line", "reason")


JSONL_REJECTS_SQL = f"""
SELECT part, line, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'JSONL_PARSE' ELSE 'JSONL_OBJECT' END AS reason
FROM (SELECT o_orderkey AS k, part, row_number() OVER (PARTITION BY part ORDER BY o_orderkey) AS line
      FROM (SELECT o_orderkey, (o_orderkey // {FILE_KEYS})::BIGINT AS part FROM orders))
WHERE k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0
"""


def q_jsonl_long_lines(spark, d):
    """Whole texts as JSON lines: one as an object, one as a bare string, which is no table row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    array = F.to_json(F.array(text))
    bare = F.substring(array, F.lit(2), F.length(array) - 2)
    path = scratch_path(spark, "jsonl-long")
    load(spark, d, "documents").df.select(F.explode(F.array(F.to_json(F.struct("doc_id", text.alias("text"))), bare)).alias("value")).write.text(path)
    rows = read_jsonl(spark, path, strict=False).to_df(ordered=False).select(F.lit("row").alias("kind"), "doc_id", F.length("text").alias("n"))
    bad = jsonl_rejects(spark, path).groupBy(F.col("reason").alias("kind")).agg(F.lit(None).cast("long").alias("doc_id"), F.count("*").cast("int").alias("n"))
    return rows.unionByName(bad)


JSONL_LONG_LINES_SQL = """
SELECT 'row' AS kind, doc_id, length(coalesce(text, ''))::INT AS n FROM documents
UNION ALL SELECT 'JSONL_OBJECT', NULL, count(*)::INT FROM documents
"""


def q_jsonl_sparse_keys(spark, d):
    """Values of keys that only some lines have, in typed columns."""
    o = load(spark, d, "orders").df
    doc = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct("o_orderkey", F.col("o_totalprice").alias("price")))) \
        .otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), "o_orderkey")))
    path = scratch_path(spark, "jsonl-sparse")
    o.select(doc.alias("value")).write.text(path)
    return read_jsonl(spark, path).to_df(ordered=False).select("o_orderkey", "price", "status")


# -- O-3, F1-F6, C5-C7: long digit runs, exact integers, boundary cells --------------------------------

def q_natural_long_digits(spark, d):
    o = load(spark, d, "orders").df
    n = F.concat(F.repeat((F.col("o_orderkey") % 9 + 1).cast("string"), (F.col("o_orderkey") % 70 + 1).cast("int")), F.col("o_orderkey"))
    return with_rank(sort_rows(Table(o.select(F.concat(F.lit("Run "), n).alias("name"))), [{"column": "name"}]))


NATURAL_LONG_DIGITS_SQL = """
SELECT 'Run ' || n AS name, row_number() OVER (ORDER BY len(n), n) AS rank FROM (
  SELECT repeat((o_orderkey % 9 + 1)::VARCHAR, (o_orderkey % 70 + 1)::INT) || o_orderkey AS n FROM orders)
"""


def q_filter_bigint(spark, d):
    o = load(spark, d, "orders").df
    t = Table(o.select((F.col("o_orderkey") + 9007199254740000).alias("big")))
    return filter_rows(t, [rule("big", "gte", "9007199254740993"), rule("big", "neq", 9007199254740995),
                           rule("big", "lt", 9007199254750001.5)]).to_df()


EDGE_CELLS = ("-9223372036854775808", "9007199254740991", "9007199254740992", "0xffffffffffffffffff", "1e400", "12.0", "")


def q_cast_edge_null(spark, d):
    o = load(spark, d, "orders").df
    cell = F.element_at(F.array(*[F.lit(c) for c in EDGE_CELLS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    t = Table(o.select("o_orderkey", cell.alias("as_int"), cell.alias("as_number"),
                       F.when(F.col("o_orderkey") % 2 == 0, F.lit(-2 ** 63).cast("long")).otherwise(F.col("o_orderkey")).alias("big")))
    return cast_columns(t, [{"column": "as_int", "type": "integer"}, {"column": "as_number", "type": "number"},
                            {"column": "big", "type": "integer"}], "null").to_df()


CAST_EDGE_NULL_SQL = """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 9007199254740991 WHEN 5 THEN 12 END AS as_int,
       CASE o_orderkey % 7 WHEN 0 THEN -9223372036854775808::DOUBLE WHEN 1 THEN 9007199254740991::DOUBLE
            WHEN 2 THEN 9007199254740992::DOUBLE WHEN 5 THEN 12::DOUBLE END AS as_number,
       CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END AS big FROM orders
"""


def q_cast_to_string(spark, d):
    t = select_columns(load(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderdate"])
    return cast_columns(t, [{"column": c, "type": "string"} for c in t.columns]).to_df()


CAST_TO_STRING_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
       CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
            ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS o_orderdate FROM orders
"""


# -- row order from the file (G1, D1 with the default order) -------------------------------------------

def q_group_first_seen(spark, d):
    t = select_columns(load(spark, d, "orders", keep_order=True), ["o_custkey", "o_orderkey"])
    return with_rank(group_by(t, ["o_custkey"], [agg("count", "*", "n"), agg("sum", "o_orderkey", "keys")]))


def q_dedup_file_order(spark, d):
    t = select_columns(load(spark, d, "orders", keep_order=True), ["o_custkey", "o_orderkey", "o_totalprice"])
    return with_rank(deduplicate_rows(t, ["o_custkey"]))


# -- P1 on a wide table -------------------------------------------------------------------------------

WIDE = 100


def q_profile_wide(spark, d):
    li = load(spark, d, "lineitem").df
    kinds = (F.col("l_orderkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.nullif(F.col("l_returnflag"), F.lit("N")),
             F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(F.col("l_extendedprice").cast("string")))
    return infer_schema(Table(li.select(*[kinds[i % 4].alias(f"c{i}") for i in range(WIDE)])))


PROFILE_WIDE_SQL = f"""
WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS nulls, count(*) FILTER (WHERE l_linenumber = 1) AS empties
           FROM lineitem)
SELECT i::INT AS position, 'c' || i AS name, i % 4 = 2 AND nulls > 0 AS nullable, CASE WHEN i % 4 = 2 THEN nulls ELSE 0 END AS nullCount,
       CASE WHEN i % 4 = 3 THEN empties ELSE 0 END AS emptyCount,
       n - CASE i % 4 WHEN 2 THEN nulls WHEN 3 THEN empties ELSE 0 END AS observedCount,
       ['integer', 'date', 'string', 'number'][i % 4 + 1] AS type
FROM s, range({WIDE}) r(i)
"""


# -- J6: null keys -------------------------------------------------------------------------------------

def _join_null_query(how):
    def run(spark, d):
        o, c = load(spark, d, "orders").df, load(spark, d, "customer").df
        left = Table(o.select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("cust")))
        right = Table(c.select("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("cust")))
        return join_tables(left, right, how, [{"left": "cust", "right": "cust"}]).to_df(ordered=False)
    return run


def _join_null_sql(how):
    return f"""
SELECT o_orderkey, o.cust AS cust, c_name, c.cust AS cust_right
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS cust FROM orders) o
{how} JOIN (SELECT c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS cust FROM customer) c ON o.cust = c.cust
"""


# -- U3, R4, P4, S5 ----------------------------------------------------------------------------------------

def q_union_mismatch(spark, d):
    """The mismatch report of a union by name, and the rows that lack a column."""
    c = select_columns(load(spark, d, "customer"), ["c_custkey", "c_name", "c_acctbal"])
    s = rename_columns(select_columns(load(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"]),
                       [{"from": "s_suppkey", "to": "c_custkey"}, {"from": "s_name", "to": "c_name"}])
    u = union_tables([c, s], mode="name")
    report = u.meta["schema_mismatch"]["inputs"]
    rows = u.df.agg(*[F.count_if(F.col(r["missing"][0]).isNull()).alias(f"n{r['index']}") for r in report])
    return rows.select(F.explode(F.array(*[F.struct(F.lit(r["index"]).alias("input"), F.lit(",".join(r["missing"])).alias("missing"),
                                                    F.lit(",".join(r["extra"])).alias("extra"), F.col(f"n{r['index']}").alias("rows"))
                                           for r in report])).alias("r")).select("r.*")


def q_join_full_hot(spark, d):
    """Full join where one key holds half of the orders and another, without a partner, many customers."""
    o, c = load(spark, d, "orders").df, load(spark, d, "customer").df
    left = Table(o.select("o_orderkey", F.when(F.col("o_custkey") % 10 < 5, F.lit(7)).otherwise(F.col("o_custkey")).cast("int").alias("cust")))
    right = Table(c.select("c_custkey", F.when(F.col("c_custkey") % 50 == 7, F.lit(7)).when(F.col("c_custkey") % 5 == 0, F.lit(-7))
                           .otherwise(F.col("c_custkey")).cast("long").alias("cust")))
    t = join_tables(left, right, "full", [{"left": "cust", "right": "cust"}], hot_rows=200)
    return group_by(t, ["cust", "cust_right"], [agg("count", "*", "n"), agg("sum", "o_orderkey", "orders"), agg("sum", "c_custkey", "customers")]).to_df(ordered=False)


JOIN_FULL_HOT_SQL = """
SELECT l.cust, r.cust AS cust_right, count(*) AS n, sum(o_orderkey)::BIGINT AS orders, sum(c_custkey)::BIGINT AS customers
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 10 < 5 THEN 7 ELSE o_custkey END AS cust FROM orders) l
FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 50 = 7 THEN 7 WHEN c_custkey % 5 = 0 THEN -7 ELSE c_custkey END AS cust FROM customer) r
ON l.cust = r.cust GROUP BY l.cust, r.cust
"""

UNION_MISMATCH_SQL = """
SELECT 0 AS input, 's_nationkey' AS missing, '' AS extra, count(*) AS rows FROM customer
UNION ALL SELECT 1, 'c_acctbal', 's_nationkey', count(*) FROM supplier
"""


def multi_output_graph() -> dict:
    return {"nodes": [
        _node("orders", "parquet-input"),
        _node("cut", "select-columns", columns=["o_orderkey", "o_orderstatus", "o_totalprice"]),
        _node("open", "filter-rows", conditions=[rule("o_orderstatus", "eq", "O")], combination="and"),
        _node("all_out", "parquet-output", filename="all"), _node("open_out", "csv-output", filename="open"),
        _node("names", "select-columns", columns=["o_orderstatus"]), _node("json_out", "jsonl-output", filename="names"),
    ], "edges": [
        _edge("e1", "orders", "table", "cut", "in"), _edge("e2", "cut", "out", "open", "in"), _edge("e3", "cut", "out", "all_out", "in"),
        _edge("e4", "open", "out", "open_out", "in"), _edge("e5", "open", "out", "names", "in"), _edge("e6", "names", "out", "json_out", "in"),
    ]}


def q_multi_output_counts(spark, d):
    """One run with three outputs; rows and columns of each, and the rows found in its files."""
    out = scratch_path(spark, "outputs")
    done = run_pipeline(spark, multi_output_graph(), {"orders": f"{d}/orders.parquet"}, out)
    read = {"PARQUET": read_parquet, "CSV": read_csv, "JSONL": read_jsonl}
    parts = [read[r["format"]](spark, r["path"]).df.agg(F.count(F.lit(1)).alias("read_back"))
             .select(F.lit(r["nodeId"]).alias("node"), F.lit(r["rows"]).cast("long").alias("rows"), F.lit(r["columns"]).alias("columns"), "read_back")
             for r in done]
    return parts[0].union(parts[1]).union(parts[2])


MULTI_OUTPUT_COUNTS_SQL = """
SELECT 'all_out' AS node, count(*) AS rows, 3 AS columns, count(*) AS read_back FROM orders
UNION ALL SELECT 'open_out', count(*), 3, count(*) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'json_out', count(*), 1, count(*) FROM orders WHERE o_orderstatus = 'O'
"""


def q_preview_limited(spark, d):
    """Preview of a node below row-local nodes: reads the first rows only."""
    return preview_node(spark, multi_output_graph(), "open", {"orders": f"{d}/orders.parquet"})[0]


PREVIEW_LIMITED_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
       CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
            ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice
FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' LIMIT 100)
"""


def q_preview_csv(spark, d):
    """Preview below a filter over a folder of CSV files: files are read in order until it has its rows."""
    o = _orders_text(spark, d)
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus")
    path = _write_lines(o.select("o_orderkey", line.alias("value")), "o_orderkey", scratch_path(spark, "preview-csv"), "o_orderkey,o_custkey,o_orderstatus")
    graph = {"nodes": [_node("orders", "csv-input", delimiter="auto", header=True),
                       _node("open", "filter-rows", conditions=[rule("o_orderstatus", "eq", "O")], combination="and")],
             "edges": [_edge("e1", "orders", "table", "open", "in")]}
    return preview_node(spark, graph, "open", {"orders": path})[0]


PREVIEW_CSV_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus
FROM orders WHERE o_orderstatus = 'O' ORDER BY orders.o_orderkey LIMIT 100
"""


def shared_graph() -> dict:
    """orders x customer, grouped per market segment; two outputs of the group and one of the join."""
    return {"nodes": [
        _node("orders", "parquet-input"), _node("customers", "parquet-input"),
        _node("open", "filter-rows", conditions=[rule("o_orderstatus", "eq", "O")], combination="and"),
        _node("both", "join", type="inner", keys=[{"left": "o_custkey", "right": "c_custkey"}]),
        _node("per_nation", "group-by", groups=["c_nationkey"], aggregates=[agg("count", "*", "n"), agg("max", "o_totalprice", "top")]),
        _node("many", "filter-rows", conditions=[rule("n", "gt", 60)], combination="and"),
        _node("rows_out", "parquet-output", filename="rows"), _node("groups_out", "csv-output", filename="groups"),
        _node("many_out", "jsonl-output", filename="many"),
    ], "edges": [
        _edge("e1", "orders", "table", "open", "in"), _edge("e2", "open", "out", "both", "left"), _edge("e3", "customers", "table", "both", "right"),
        _edge("e4", "both", "out", "rows_out", "in"), _edge("e5", "both", "out", "per_nation", "in"), _edge("e6", "per_nation", "out", "groups_out", "in"),
        _edge("e7", "per_nation", "out", "many", "in"), _edge("e8", "many", "out", "many_out", "in"),
    ]}


def q_node_counts(spark, d):
    """Rows in and out of every node of a run with shared upstream nodes."""
    done = run_pipeline(spark, shared_graph(), {"orders": f"{d}/orders.parquet", "customers": f"{d}/customer.parquet"},
                        scratch_path(spark, "shared-outputs"), keep_order=False, node_counts=True)
    rows = [(n, sum(c["in"]), c["out"]) for n, c in done[0]["nodeRows"].items()]
    return spark.createDataFrame(rows, "node string, rows_in long, rows_out long")


NODE_COUNTS_SQL = """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders), c AS (SELECT count(*) AS n FROM customer),
j AS (SELECT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'),
g AS (SELECT c_nationkey, count(*) AS n FROM j GROUP BY c_nationkey), s AS (
    SELECT (SELECT count(*) FROM j) AS j, (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM g WHERE n > 60) AS m)
SELECT 'orders' AS node, 0::BIGINT AS rows_in, n AS rows_out FROM o UNION ALL SELECT 'customers', 0, n FROM c UNION ALL SELECT 'open', n, open FROM o
UNION ALL SELECT 'both', o.open + c.n, s.j FROM o, c, s UNION ALL SELECT 'per_nation', j, g FROM s UNION ALL SELECT 'many', g, m FROM s
UNION ALL SELECT 'rows_out', j, j FROM s UNION ALL SELECT 'groups_out', g, g FROM s UNION ALL SELECT 'many_out', m, m FROM s
"""


QUERIES = {
    "pricing_summary": pricing_summary,
    "shipping_top10": shipping_top10,
    "select_rename": q_select_rename,
    "clean_text": q_clean_text,
    "cast_modes": q_cast_modes,
    "filter_and": q_filter_and,
    "filter_or": q_filter_or,
    "filter_range": q_filter_range,
    "filter_null": q_filter_null,
    "filter_not_null": q_filter_not_null,
    "null_remove": q_null_remove,
    "null_replace": q_null_replace,
    "sort_multi": q_sort_multi,
    "limit_n": q_limit_n,
    "top_k": q_top_k,
    "natural_sort": q_natural_sort,
    "dedup_all": q_dedup_all,
    "dedup_keys": q_dedup_keys,
    "join_inner": _join_query("inner"),
    "join_left": _join_query("left"),
    "join_right": _join_query("right"),
    "join_full": _join_query("full"),
    "join_multi_key": q_join_multi_key,
    "join_strict_types": q_join_strict_types,
    "join_strict_left": q_join_strict_left,
    "union_name": q_union_name,
    "union_position": q_union_position,
    "group_multi": q_group_multi,
    "group_global": q_group_global,
    "group_empty": q_group_empty,
    "min_max_text": q_min_max_text,
    "group_text_sum": q_group_text_sum,
    "profile": q_profile,
    "type_census": q_type_census,
    "preview": q_preview,
    "csv_round_trip": q_csv_round_trip,
    "delimiter_folder": q_delimiter_folder,
    "jsonl_round_trip": q_jsonl_round_trip,
    "jsonl_columns": q_jsonl_columns,
    "parquet_round_trip": q_parquet_round_trip,
    "saved_run": q_saved_run,
    "recipe_rebind": q_recipe_rebind,
    "csv_mixed_headers": q_csv_mixed_headers,
    "csv_rejects": q_csv_rejects,
    "csv_multiline": q_csv_multiline,
    "jsonl_rejects": q_jsonl_rejects,
    "jsonl_long_lines": q_jsonl_long_lines,
    "jsonl_sparse_keys": q_jsonl_sparse_keys,
    "natural_long_digits": q_natural_long_digits,
    "filter_bigint": q_filter_bigint,
    "cast_edge_null": q_cast_edge_null,
    "cast_to_string": q_cast_to_string,
    "group_first_seen": q_group_first_seen,
    "dedup_file_order": q_dedup_file_order,
    "profile_wide": q_profile_wide,
    "join_full_hot": q_join_full_hot,
    "join_null_inner": _join_null_query("inner"),
    "join_null_left": _join_null_query("left"),
    "join_null_right": _join_null_query("right"),
    "join_null_full": _join_null_query("full"),
    "union_mismatch": q_union_mismatch,
    "multi_output_counts": q_multi_output_counts,
    "preview_limited": q_preview_limited,
    "preview_csv": q_preview_csv,
    "node_counts": q_node_counts,
}

ORACLE_SQL = {
    "pricing_summary": PRICING_SUMMARY_SQL,
    "shipping_top10": SHIPPING_TOP10_SQL,
    "select_rename": "SELECT c_custkey, c_name AS name, c_nationkey AS c_mktsegment, c_mktsegment AS c_nationkey FROM customer",
    "clean_text": "SELECT p_partkey, lower(upper(p_name)) AS key FROM part",
    "cast_modes": CAST_MODES_SQL,
    "filter_and": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_shipdate FROM lineitem
                     WHERE l_quantity > 30 AND l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1995-06-01'""",
    "filter_or": """SELECT p_partkey, p_name, p_brand, p_type FROM part
                    WHERE ends_with(p_brand, '#13') OR starts_with(p_name, 'red') OR contains(p_type, 'PROMO')""",
    "filter_range": """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
                       WHERE o_totalprice >= 100000 AND o_totalprice <= 200000 AND o_orderpriority <> '5-LOW'""",
    "filter_null": "SELECT event_id, NULLIF(event_type, 'error') AS event_type FROM events WHERE event_type = 'error'",
    "filter_not_null": "SELECT event_id, event_type FROM events WHERE event_type <> 'error'",
    "null_remove": "SELECT event_id, event_type FROM events WHERE event_type <> 'error'",
    "null_replace": "SELECT event_id, COALESCE(NULLIF(event_type, 'error'), 'unknown') AS event_type FROM events",
    "sort_multi": SORT_MULTI_SQL,
    "limit_n": "SELECT o_orderkey, o_custkey FROM orders LIMIT 10",
    "top_k": """SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
                FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
    "natural_sort": """SELECT p_brand, row_number() OVER (ORDER BY CAST(split_part(p_brand, '#', 2) AS INTEGER)) AS rank
                       FROM (SELECT DISTINCT p_brand FROM part)""",
    "dedup_all": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "dedup_keys": """SELECT doc_id, lang, source, n_chars FROM (
                       SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "join_inner": _join_sql("INNER"),
    "join_left": _join_sql("LEFT"),
    "join_right": _join_sql("RIGHT"),
    "join_full": _join_sql("FULL"),
    "join_multi_key": JOIN_MULTI_KEY_SQL,
    "join_strict_types": """SELECT false AS right_only, count(*) AS rows, 0 AS keys, sum(o_custkey)::BIGINT AS cust_sum FROM orders
                            UNION ALL SELECT true, count(*), count(*), NULL FROM customer""",
    "join_strict_left": "SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS key_txt, CAST(NULL AS VARCHAR) AS o_orderstatus FROM orders",
    "union_name": UNION_NAME_SQL,
    "union_position": "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
    "group_multi": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
                             round(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax
                      FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "group_global": """SELECT count(*) AS n, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_discount), 4) AS avg_disc,
                              min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem""",
    "group_empty": "SELECT count(*) AS n, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_quantity > 1000",
    "min_max_text": """SELECT p_type, min_by(p_brand, CAST(split_part(p_brand, '#', 2) AS INTEGER)) AS min_brand,
                              max_by(p_brand, CAST(split_part(p_brand, '#', 2) AS INTEGER)) AS max_brand
                       FROM part GROUP BY p_type""",
    "group_text_sum": """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean,
                                min(o_totalprice) AS low, max(o_totalprice) AS high
                         FROM orders GROUP BY o_orderpriority""",
    "profile": PROFILE_SQL,
    "type_census": TYPE_CENSUS_SQL,
    "preview": PREVIEW_SQL,
    "csv_round_trip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "delimiter_folder": DELIMITER_FOLDER_SQL,
    "jsonl_round_trip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    "jsonl_columns": JSONL_COLUMNS_SQL,
    "parquet_round_trip": "SELECT * FROM lineitem",
    "saved_run": SAVED_RUN_SQL,
    "recipe_rebind": RECIPE_REBIND_SQL,
    "csv_mixed_headers": CSV_MIXED_HEADERS_SQL,
    "csv_rejects": CSV_REJECTS_SQL,
    "csv_multiline": """SELECT c_custkey, c_name || chr(10) || 'say "hi", ' || c_mktsegment AS note FROM customer""",
    "jsonl_rejects": JSONL_REJECTS_SQL,
    "jsonl_long_lines": JSONL_LONG_LINES_SQL,
    "jsonl_sparse_keys": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price,
                                   CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders""",
    "natural_long_digits": NATURAL_LONG_DIGITS_SQL,
    "filter_bigint": """SELECT big FROM (SELECT o_orderkey + 9007199254740000 AS big FROM orders)
                        WHERE big >= 9007199254740993 AND big <> 9007199254740995 AND big <= 9007199254750001""",
    "cast_edge_null": CAST_EDGE_NULL_SQL,
    "cast_to_string": CAST_TO_STRING_SQL,
    "group_first_seen": """SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, row_number() OVER (ORDER BY min(rn)) AS rank
                           FROM (SELECT *, row_number() OVER () AS rn FROM orders) GROUP BY o_custkey""",
    "dedup_file_order": """SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (ORDER BY rn) AS rank FROM (
                             SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rn) AS nth
                             FROM (SELECT *, row_number() OVER () AS rn FROM orders)) WHERE nth = 1""",
    "profile_wide": PROFILE_WIDE_SQL,
    "join_full_hot": JOIN_FULL_HOT_SQL,
    "join_null_inner": _join_null_sql("INNER"),
    "join_null_left": _join_null_sql("LEFT"),
    "join_null_right": _join_null_sql("RIGHT"),
    "join_null_full": _join_null_sql("FULL"),
    "union_mismatch": UNION_MISMATCH_SQL,
    "multi_output_counts": MULTI_OUTPUT_COUNTS_SQL,
    "preview_limited": PREVIEW_LIMITED_SQL,
    "preview_csv": PREVIEW_CSV_SQL,
    "node_counts": NODE_COUNTS_SQL,
}
