"""Checks that travel with the rows, and outputs that take their place only when whole."""

import os

import pytest
from conftest import make_table, rows_of

import tablewright as tw
from tablewright.errors import TableError
from tablewright.sinks.files import write_csv, write_jsonl, write_parquet
from tablewright.sources.parquet import read_parquet


def cells(spark, values):
    return make_table(spark, [(i, v) for i, v in enumerate(values)], "i int, v string", ordered=False)


def to_integer(t):
    return tw.cast_columns(t, [{"column": "v", "type": "integer"}])


@pytest.mark.parametrize("write", [write_csv, write_jsonl, write_parquet])
@pytest.mark.parametrize("single", [False, True])
def test_a_failing_cast_leaves_no_file(spark, scratch, write, single):
    path = os.path.join(scratch, "out")
    with pytest.raises(TableError) as e:
        write(to_integer(cells(spark, ["1", "x", "y"])), path, single_file=single)
    assert e.value.code == "CAST_FAILED" and e.value.column == "v" and e.value.count == 2 and e.value.value in ("x", "y")
    assert os.listdir(scratch) == []


def test_a_failing_write_leaves_the_old_output(spark, scratch):
    path = os.path.join(scratch, "out")
    assert write_parquet(to_integer(cells(spark, ["1", "2"])), path) == 2
    with pytest.raises(TableError):
        write_parquet(to_integer(cells(spark, ["1", "x"])), path)
    assert sorted(rows_of(read_parquet(spark, path), ordered=False)) == [(0, 1), (1, 2)]


def test_clean_rows_are_written_by_one_job(spark, scratch):
    t = to_integer(cells(spark, [str(n) for n in range(100)]))
    spark.sparkContext.setJobGroup("one-write", "one write")
    try:
        assert write_parquet(t, os.path.join(scratch, "out")) == 100
    finally:
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one-write")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1


def test_rows_dropped_later_are_checked_too(spark, scratch):
    t = to_integer(cells(spark, ["1", "x"]))
    for later in (tw.select_columns(t, ["i"]), tw.filter_rows(t, [{"column": "i", "operator": "eq", "value": 0}]),
                  tw.group_by(t, [], [{"operation": "count", "column": "*", "as": "n"}]), tw.deduplicate_rows(t, ["i"]),
                  tw.limit_rows(t, 1), tw.limit_rows(tw.sort_rows(t, [{"column": "i"}]), 1), tw.limit_rows(t, 0),
                  tw.join_tables(t, cells(spark, []), "inner", [{"left": "i", "right": "i"}]), tw.union_tables([t, t])):
        with pytest.raises(TableError) as e:
            write_parquet(later, os.path.join(scratch, "out"))
        assert e.value.code == "CAST_FAILED" and e.value.value == "x"


def test_rows_filtered_before_are_not_checked(spark, scratch):
    t = tw.filter_rows(cells(spark, ["1", "x"]), [{"column": "i", "operator": "eq", "value": 0}])
    assert write_parquet(to_integer(t), os.path.join(scratch, "out")) == 1


def test_the_first_of_several_checks_is_named(spark, scratch):
    t = to_integer(cells(spark, ["1", "x"]))
    g = tw.group_by(tw.rename_columns(cells(spark, ["1", "z"]), [{"from": "v", "to": "w"}]), [], [{"operation": "sum", "column": "w", "as": "s"}])
    with pytest.raises(TableError) as e:
        write_csv(g, os.path.join(scratch, "sum"))
    assert e.value.code == "AGGREGATE_NUMERIC_REQUIRED" and e.value.value == "z"
    twice = tw.cast_columns(tw.select_columns(t, ["i", "v"]), [{"column": "i", "type": "boolean"}])
    with pytest.raises(TableError) as e:
        write_csv(twice, os.path.join(scratch, "twice"))
    assert e.value.code == "CAST_FAILED" and e.value.column == "v"


def test_validate_still_runs_all_checks(spark):
    with pytest.raises(TableError):
        to_integer(cells(spark, ["x"])).validate()
    assert to_integer(cells(spark, ["1"])).validate().df.count() == 1
