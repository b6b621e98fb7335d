"""Full joins with keys that hold a large share of the rows."""

import pytest
from conftest import make_table, rows_of
from pyspark.sql import functions as F

import tablewright as tw
from tablewright.operators import combine
from tablewright.table import Table

KEYS = [{"left": "k", "right": "k"}]


def sides(spark, ordered=False):
    left = [(i, 1 if i % 2 else i) for i in range(200)] + [(500 + i, 9) for i in range(60)] + [(900, None), (901, None)]
    right = [(i, float(i)) for i in range(0, 200, 3)] + [(300 + i, 1.0) for i in range(3)] + [(400 + i, -0.5) for i in range(70)] + [(990, None), (991, float("nan"))]
    return make_table(spark, left, "a int, k int", ordered), make_table(spark, right, "b int, k double", ordered)


@pytest.mark.parametrize("ordered", [False, True])
def test_hot_keys_give_the_same_rows(spark, ordered):
    left, right = sides(spark, ordered)
    plain = rows_of(tw.join_tables(left, right, "full", KEYS), ordered=ordered)
    hot = rows_of(tw.join_tables(left, right, "full", KEYS, hot_rows=20), ordered=ordered)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert (list(map(key, hot)) == list(map(key, plain))) if ordered else sorted(map(key, hot)) == sorted(map(key, plain))
    assert len(hot) > 300


def test_several_keys_and_colliding_buckets(spark, monkeypatch):
    monkeypatch.setattr(combine, "HOT_BUCKETS", 2)  # every bucket is hot and holds many keys
    left = make_table(spark, [(i, str(i % 3), i % 5) for i in range(100)], "a int, s string, n int", False)
    right = make_table(spark, [(i, str(i % 4), i % 7) for i in range(60)], "b int, s string, n long", False)
    keys = [{"left": "s", "right": "s"}, {"left": "n", "right": "n"}]
    plain, hot = (sorted(map(str, rows_of(tw.join_tables(left, right, "full", keys, hot_rows=h), ordered=False))) for h in (None, 5))
    assert hot == plain


def test_no_task_holds_the_hot_key(spark):
    left = Table(spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a")))
    right = Table(spark.range(1, 1000).select(F.col("id").alias("k"), F.col("id").alias("b")))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = tw.join_tables(left, right, "full", KEYS, hot_rows=5_000).df
        sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == tw.join_tables(left, right, "full", KEYS).df.count() and max(sizes) < 60_000


def test_parts_keep_copies_in_proportion_to_rows():
    """Copies grew with rows * rows / hot_rows: 4.5 and 0.018 million rows of one key made 405 million."""
    left, right = combine._parts(4_500_000, 18_000, 200)
    assert (left, right) == (250, 1) and 18_000 * left <= 4_500_000
    assert combine._parts(0, 160_000, 200) == (1, 800) and combine._parts(3, 5, 200) == (1, 1)
    left, right = combine._parts(4_000_000, 2_000_000, 200)
    assert 4_000_000 * right + 2_000_000 * left <= 2 * 4_000_000 * 2_000_000 // combine.CELL_ROWS


def test_both_sides_in_parts_meet_once(spark, monkeypatch):
    monkeypatch.setattr(combine, "CELL_ROWS", 10)
    left, right = sides(spark)
    plain, hot = (sorted(map(str, rows_of(tw.join_tables(left, right, "full", KEYS, hot_rows=h), ordered=False))) for h in (None, 5))
    assert hot == plain


def test_copies_are_not_broadcast_and_buckets_are_rows(spark):
    """The copied side was sent whole to the driver, as its size was estimated without the copies; each hot bucket was a branch of an expression."""
    left = Table(spark.range(3000).select((F.col("id") % 300).alias("k"), F.col("id").alias("a")))
    right = Table(spark.range(300).select(F.col("id").alias("k"), F.col("id").alias("b")))
    df = tw.join_tables(left, right, "full", KEYS, hot_rows=10).df
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 3000 and "strategy=merge" in plan and plan.count("CASE WHEN") < 20 and len(plan) < 100_000


AGGREGATES = [{"operation": o, "column": c, "as": f"{o}_{c}"} for o, c in (
    ("count", "*"), ("sum", "a"), ("sum", "b"), ("average", "b"), ("average", "k_right"), ("min", "a"), ("max", "b"), ("max", "k_right"))]


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("groups", [["k", "k_right"], ["k"], []])
def test_groups_of_hot_pairs_are_those_of_the_plain_join(spark, ordered, groups):
    left, right = sides(spark, ordered)
    plain, hot = (tw.group_by(tw.join_tables(left, right, "full", KEYS, hot_rows=h), groups, AGGREGATES) for h in (None, 20))
    assert hot.df.schema.simpleString().split("__tw_")[0] == plain.df.schema.simpleString().split("__tw_")[0]
    plain, hot = ([tuple(str(v) for v in r) for r in rows_of(t, ordered=ordered)] for t in (plain, hot))
    assert hot == plain if ordered else sorted(hot) == sorted(plain)


def test_text_extremes_of_hot_pairs(spark):
    left = make_table(spark, [(f"r{i % 12}", 1) for i in range(60)], "t string, k int", False)
    right = make_table(spark, [(i, 1) for i in range(30)] + [(99, 2)], "b int, k int", False)
    rules = [{"operation": o, "column": "t", "as": o} for o in ("min", "max")] + [{"operation": "count", "column": "*", "as": "n"}]
    plain, hot = (sorted(map(str, rows_of(tw.group_by(tw.join_tables(left, right, "full", KEYS, hot_rows=h), ["k_right"], rules), ordered=False))) for h in (None, 5))
    assert hot == plain and "'r0', 'r11', 1800" in hot[0]


def test_hot_pairs_are_joined_and_aggregated_in_one_stage(spark):
    """A union lay between the join of the pairs and their partial aggregate, so each pair was written as a row: 131 ns a pair, of 2,251 million."""
    left, right = sides(spark)
    df = tw.group_by(tw.join_tables(left, right, "full", KEYS, hot_rows=20), ["k", "k_right"], AGGREGATES[:3]).df
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "Inner" in line)
    above = [line.strip(" :+-").split(" ")[0].split("(")[0] for line in lines[at - 2:at]]
    assert above == ["HashAggregate", "Project"] and "partial_count" in lines[at - 2]


def test_cells_are_dealt_to_tasks_by_their_pairs(spark, monkeypatch):
    """The shuffle before the pairs has few bytes, so they were left to a few tasks, of which some had twice the pairs of others."""
    assert combine._cell_tasks([(1, 4_500_000, 18_000)], 200) == 4 * 250 and combine._cell_tasks([(1, 750_000, 3_000), (2, 0, 30_000)], 200) == 45
    assert combine._cell_tasks([(1, 300, 200), (2, 0, 5_000)], 200) == 0
    left, right = sides(spark)[0], make_table(spark, [(i, i % 4) for i in range(120)] + [(500, None)], "b int, k long", False)
    fractions = Table(right.df.withColumn("k", F.col("k").cast("double")))
    plain = sorted(map(str, rows_of(tw.join_tables(left, right, "full", KEYS), ordered=False)))
    monkeypatch.setattr(combine, "CELL_ROWS", 2)
    monkeypatch.setattr(combine, "TASK_PAIRS", 10)
    table, other = (tw.join_tables(left, t, "full", KEYS, hot_rows=2) for t in (right, fractions))
    shuffles, others = ([line for line in t.parts[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in line] for t in (table, other))
    assert len(shuffles) == len(others) == 2 and all("REPARTITION_BY_NUM" in line for line in shuffles)
    assert sorted(map(str, rows_of(table, ordered=False))) == plain
