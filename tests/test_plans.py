"""Plan shape: pushdown, pruning, no Python in operators, map-side aggregation."""

import pytest

import tablewright as tw
from tablewright.plans import catalog as C

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_typed_filter_is_pushed_and_columns_pruned(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    li = tw.select_columns(C.load(spark, SF, "lineitem"), ["l_orderkey", "l_quantity", "l_shipdate"])
    out = tw.filter_rows(li, [C.rule("l_quantity", "gt", 30), C.rule("l_shipdate", "lte", "1998-09-02")]).to_df()
    p = plan(out)
    assert "GreaterThan(l_quantity,30" in p and "LessThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz" in p


def test_no_python_in_operator_plans(spark):
    queries = ["filter_or", "sort_multi", "group_text_sum", "cast_modes", "join_full", "union_name", "dedup_keys",
               "min_max_text", "clean_text", "profile", "type_census"]
    for name in queries:
        p = plan(C.QUERIES[name](spark, SF))
        for marker in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonMapInArrow"):
            assert marker not in p, (name, marker)


def test_group_by_aggregates_map_side(spark):
    g = tw.group_by(C.load(spark, SF, "lineitem"), ["l_returnflag"], [C.agg("sum", "l_quantity", "q")])
    p = plan(g.to_df())
    assert "partial_sum" in p


def test_ordered_dedup_is_a_partial_aggregate(spark):
    docs = tw.sort_rows(C.load(spark, SF, "documents"), [{"column": "doc_id"}])
    p = plan(tw.deduplicate_rows(docs, ["lang"]).to_df())
    assert "partial_min_by" in p and "Window" not in p


def test_full_join_reads_each_side_once(spark):
    cust, orders = C._join_sides(spark, SF)
    p = plan(tw.join_tables(cust, orders, "full", [{"left": "c_custkey", "right": "o_custkey"}]).to_df())
    assert "Union" not in p and "FullOuter" in p and p.count("Scan parquet") == 2


def test_null_keys_are_dealt_out(spark):
    left = spark.range(1000).selectExpr("id", "cast(null as long) as k")
    right = spark.range(10).selectExpr("id as rid", "id as k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = tw.join_tables(left, right, "left", [{"left": "k", "right": "k"}]).to_df()
        sizes = [len(p) for p in out.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1000 and max(sizes) < 300


def test_plain_scans_are_not_shuffled(spark):
    p = plan(tw.select_columns(C.load(spark, SF, "lineitem"), ["l_orderkey"]).to_df())
    assert "Exchange" not in p


def test_ordered_numeric_groups_use_hash_aggregates(spark):
    t = tw.select_columns(C.load(spark, SF, "orders", keep_order=True), ["o_custkey", "o_orderkey"])
    p = plan(tw.group_by(t, ["o_custkey"], [C.agg("count", "*", "n"), C.agg("sum", "o_orderkey", "keys")]).df)
    assert "HashAggregate" in p and "SortAggregate" not in p


def test_saved_run_carries_no_order_it_does_not_need(spark):
    inputs = {"customers": f"{SF}/customer.parquet", "orders": f"{SF}/orders.parquet", "items": f"{SF}/lineitem.parquet"}
    p = plan(C.evaluate_node(spark, C.revenue_graph(), "sorted", inputs).to_df())
    assert "SortAggregate" not in p and "row_index" not in p
