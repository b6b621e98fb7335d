"""Operator expectations ported from the reference's unit tests."""

import datetime as dt

import pytest

import tablewright as tw
from tablewright import TableError
from conftest import make_table, rows_of


def codes(fn):
    with pytest.raises(TableError) as e:
        fn()
    return e.value


def test_rename_keeps_order(spark):
    t = make_table(spark, [(1, "A", 10)], "id long, name string, price long")
    out = tw.rename_columns(t, [{"from": "name", "to": "customer_name"}, {"from": "price", "to": "amount"}])
    assert out.columns == ["id", "customer_name", "amount"]
    assert rows_of(out) == [(1, "A", 10)]


def test_rename_swap_and_errors(spark):
    t = make_table(spark, [(1, "A")], "id long, name string")
    out = tw.rename_columns(t, [{"from": "id", "to": "name"}, {"from": "name", "to": "id"}])
    assert out.columns == ["name", "id"] and rows_of(out) == [(1, "A")]
    e = codes(lambda: tw.rename_columns(t, [{"from": "missing", "to": "x"}]))
    assert e.code == "COLUMN_NOT_FOUND" and e.column == "missing"
    e = codes(lambda: tw.rename_columns(t, [{"from": "name", "to": "id"}]))
    assert e.code == "COLUMN_NAME_COLLISION" and e.column == "id"
    assert codes(lambda: tw.rename_columns(t, [{"from": "name", "to": ""}])).code == "INVALID_RENAME"
    assert codes(lambda: tw.rename_columns(t, [{"from": "id", "to": "a"}, {"from": "id", "to": "b"}])).code == "INVALID_RENAME"


def test_select(spark):
    t = make_table(spark, [(1, "A", 2)], "id long, name string, price long")
    assert tw.select_columns(t, ["price", "id"]).columns == ["price", "id"]
    assert tw.select_columns(t, None).columns == ["id", "name", "price"]
    assert codes(lambda: tw.select_columns(t, [])).code == "NO_COLUMNS"
    assert codes(lambda: tw.select_columns(t, ["nope"])).code == "COLUMN_NOT_FOUND"


def test_sort_multi_key_nulls_last(spark):
    t = make_table(spark, [("b", "2", 3), ("a", "10", 2), ("a", "3", 1), ("a", None, 4)],
                   "`group` string, score string, id long")
    out = tw.sort_rows(t, [{"column": "group", "direction": "asc"}, {"column": "score", "direction": "desc"}])
    assert [r[2] for r in rows_of(out)] == [2, 1, 4, 3]


def test_sort_natural_and_stable(spark):
    vals = ["item10", "Item2", "item002", "_z", "9", "ábc", "ABC", "abd", "", None]
    t = make_table(spark, [(v, i) for i, v in enumerate(vals)], "s string, i long")
    out = tw.sort_rows(t, [{"column": "s"}])
    assert [r[0] for r in rows_of(out)] == ["9", "_z", "ábc", "ABC", "abd", "Item2", "item002", "item10", "", None]


def test_limit(spark):
    t = make_table(spark, [(1,), (2,), (3,)], "id long")
    assert rows_of(tw.limit_rows(t, 2)) == [(1,), (2,)]
    assert rows_of(tw.limit_rows(t, 0)) == []
    assert codes(lambda: tw.limit_rows(t, -1)).code == "INVALID_LIMIT"
    assert codes(lambda: tw.limit_rows(t, 1.5)).code == "INVALID_LIMIT"


def test_cast_null_mode(spark):
    t = make_table(spark, [("12", "3.5", "true", "2026-09-17", "2026-09-17 08:30:00"),
                           ("bad", "", "0", "bad", None)],
                   "id string, price string, active string, date string, created string")
    out = tw.cast_columns(t, [{"column": "id", "type": "integer"}, {"column": "price", "type": "number"},
                              {"column": "active", "type": "boolean"}, {"column": "date", "type": "date"},
                              {"column": "created", "type": "timestamp"}], "null")
    rows = rows_of(out)
    assert rows[0][:4] == (12, 3.5, True, dt.date(2026, 9, 17))
    assert rows[0][4] == dt.datetime(2026, 9, 17, 8, 30)
    assert rows[1] == (None, None, False, None, None)


def test_cast_error_mode(spark):
    t = make_table(spark, [("oops",)], "price string")
    out = tw.cast_columns(t, [{"column": "price", "type": "number"}], "error")
    e = codes(out.validate)
    assert e.code == "CAST_FAILED" and e.column == "price" and e.value == "oops"
    assert codes(lambda: tw.cast_columns(t, [{"column": "price", "type": "money"}])).code == "CAST_TYPE_UNSUPPORTED"
    assert codes(lambda: tw.cast_columns(t, [{"column": "price", "type": ""}])).code == "INVALID_CAST"


def test_cast_integer_rules(spark):
    t = make_table(spark, [("12.0",), (" 7 ",), ("9007199254740993",), ("1.5",), ("",), ("   ",)], "v string")
    out = tw.cast_columns(t, [{"column": "v", "type": "integer"}], "null")
    assert [r[0] for r in rows_of(out)] == [12, 7, None, None, None, None]


def test_cast_to_string_js_numbers(spark):
    t = make_table(spark, [(1.0,), (2.5,), (1e21,), (None,)], "v double")
    out = tw.cast_columns(t, [{"column": "v", "type": "string"}])
    assert [r[0] for r in rows_of(out)] == ["1", "2.5", "1e+21", None]


def test_dedup(spark):
    t = make_table(spark, [(1, "A"), (1, "A"), (1, "B"), (2, "B")], "id long, name string")
    assert rows_of(tw.deduplicate_rows(t, None)) == [(1, "A"), (1, "B"), (2, "B")]
    assert rows_of(tw.deduplicate_rows(t, ["id"])) == [(1, "A"), (2, "B")]


def test_filter_and_or(spark):
    t = make_table(spark, [("1200", "active", "Alpha"), ("900", "active", "Beta"), ("1500", "paused", "Alpine")],
                   "price string, status string, name string")
    out = tw.filter_rows(t, [{"column": "price", "operator": "gt", "value": "1000"},
                             {"column": "status", "operator": "eq", "value": "active"}], "and")
    assert [r[2] for r in rows_of(out)] == ["Alpha"]
    out = tw.filter_rows(t, [{"column": "name", "operator": "starts-with", "value": "Al"},
                             {"column": "status", "operator": "eq", "value": "paused"}], "or")
    assert [r[2] for r in rows_of(out)] == ["Alpha", "Alpine"]


def test_filter_loose_text(spark):
    t = make_table(spark, [("Active",), ("active",), ("école",), ("0012",), ("item10",), ("item2",)], "s string")
    eq = lambda v: [r[0] for r in rows_of(tw.filter_rows(t, [{"column": "s", "operator": "eq", "value": v}]))]
    assert eq("ACTIVE") == ["Active", "active"]
    assert eq("ecole") == ["école"]
    assert eq("12") == ["0012"]
    gt = [r[0] for r in rows_of(tw.filter_rows(t, [{"column": "s", "operator": "gt", "value": "item9"}]))]
    assert gt == ["item10"]


def test_filter_nulls(spark):
    t = make_table(spark, [(None,), ("",), ("ok",), (None,)], "note string")
    assert rows_of(tw.filter_rows(t, [{"column": "note", "operator": "is-null"}])) == [(None,), (None,)]
    assert rows_of(tw.filter_rows(t, [{"column": "note", "operator": "not-null"}])) == [("",), ("ok",)]


def test_filter_errors(spark):
    t = make_table(spark, [(1,)], "id long")
    e = codes(lambda: tw.filter_rows(t, [{"column": "missing", "operator": "eq", "value": "1"}]))
    assert e.code == "COLUMN_NOT_FOUND" and e.column == "missing"
    assert codes(lambda: tw.filter_rows(t, [{"column": "id", "operator": "eq"}])).code == "INVALID_FILTER"
    assert codes(lambda: tw.filter_rows(t, [{"column": "id", "operator": "like", "value": 1}])).code == "INVALID_FILTER"


def test_null_remove_and_replace(spark):
    t = make_table(spark, [(1, None), (2, ""), (None, "C"), (4, "D")], "id long, name string")
    assert rows_of(tw.handle_nulls(t, "remove", ["name"])) == [(2, ""), (None, "C"), (4, "D")]
    t2 = make_table(spark, [(1, None), (2, ""), (3, "C")], "id long, name string")
    assert rows_of(tw.handle_nulls(t2, "replace", ["name"], "N/A")) == [(1, "N/A"), (2, ""), (3, "C")]
    assert codes(lambda: tw.handle_nulls(t2, "", ["name"])).code == "INVALID_NULL_HANDLING"
    assert codes(lambda: tw.handle_nulls(t2, "remove", [])).code == "INVALID_NULL_HANDLING"


def _join_inputs(spark):
    left = make_table(spark, [(1, "jp", "Alice"), (2, "jp", "Bob"), (2, "us", "Carol")],
                      "id long, region string, name string")
    right = make_table(spark, [(1, "jp", "gold"), (2, "us", "silver"), (3, "jp", "bronze")],
                       "customer_id long, region string, tier string")
    keys = [{"left": "id", "right": "customer_id"}, {"left": "region", "right": "region"}]
    return left, right, keys


def test_join_types(spark):
    left, right, keys = _join_inputs(spark)
    inner = tw.join_tables(left, right, "inner", keys)
    assert inner.columns == ["id", "region", "name", "customer_id", "region_right", "tier"]
    assert [(r[0], r[1], r[5]) for r in rows_of(inner)] == [(1, "jp", "gold"), (2, "us", "silver")]
    lj = rows_of(tw.join_tables(left, right, "left", keys))
    assert len(lj) == 3 and lj[1][5] is None
    rj = rows_of(tw.join_tables(left, right, "right", keys))
    assert len(rj) == 3 and rj[2][0] is None and rj[2][3] == 3
    fj = rows_of(tw.join_tables(left, right, "full", keys))
    assert len(fj) == 4 and fj[3][3] == 3


def test_join_nulls_and_errors(spark):
    left = make_table(spark, [(None,), (1,)], "id long")
    right = make_table(spark, [(None,), (1,)], "id long")
    out = tw.join_tables(left, right, "inner", [{"left": "id", "right": "id"}])
    assert [r[0] for r in rows_of(out)] == [1]
    assert out.columns == ["id", "id_right"]
    full = rows_of(tw.join_tables(left, right, "full", [{"left": "id", "right": "id"}]))
    assert full == [(None, None), (1, 1), (None, None)]
    e = codes(lambda: tw.join_tables(left, right, "inner", [{"left": "missing", "right": "id"}]))
    assert e.code == "COLUMN_NOT_FOUND" and e.column == "missing"
    assert codes(lambda: tw.join_tables(left, right, "inner", [])).code == "INVALID_JOIN"


def test_join_type_strict(spark):
    left = make_table(spark, [(1,)], "id long")
    right = make_table(spark, [("1",)], "id string")
    assert rows_of(tw.join_tables(left, right, "inner", [{"left": "id", "right": "id"}])) == []
    assert rows_of(tw.join_tables(left, right, "left", [{"left": "id", "right": "id"}])) == [(1, None)]


def test_union_by_name(spark):
    a = make_table(spark, [(1, "Alice")], "id long, name string")
    b = make_table(spark, [(2, True)], "id long, active boolean")
    out = tw.union_tables([a, b], mode="name")
    assert out.columns == ["id", "name", "active"]
    assert rows_of(out) == [(1, "Alice", None), (2, None, True)]
    m = out.meta["schema_mismatch"]
    assert m["hasMismatch"] and m["inputs"][1]["missing"] == ["name"] and m["inputs"][1]["extra"] == ["active"]


def test_union_by_position(spark):
    a = make_table(spark, [(1, "Alice")], "id long, name string")
    b = make_table(spark, [(2, "Bob")], "customer_id long, customer_name string")
    out = tw.union_tables([a, b], mode="position")
    assert out.columns == ["id", "name"] and rows_of(out) == [(1, "Alice"), (2, "Bob")]
    assert out.meta["schema_mismatch"]["hasMismatch"]
    c = make_table(spark, [(3,)], "id long")
    assert codes(lambda: tw.union_tables([a, c], mode="position")).code == "UNION_SCHEMA_MISMATCH"
    assert codes(lambda: tw.union_tables([a])).code == "INVALID_UNION"


def test_group_by(spark):
    t = make_table(spark, [("A", "10"), ("A", "20"), ("B", "7.5"), ("B", None)], "category string, price string")
    out = tw.group_by(t, ["category"], [
        {"operation": "count", "column": "*", "as": "count"},
        {"operation": "sum", "column": "price", "as": "total_price"},
        {"operation": "average", "column": "price", "as": "avg_price"},
        {"operation": "min", "column": "price", "as": "min_price"},
        {"operation": "max", "column": "price", "as": "max_price"},
    ])
    assert out.columns == ["category", "count", "total_price", "avg_price", "min_price", "max_price"]
    assert rows_of(out) == [("A", 2, 30.0, 15.0, "10", "20"), ("B", 2, 7.5, 7.5, "7.5", "7.5")]


def test_group_min_max_numeric_text(spark):
    t = make_table(spark, [("x", "9"), ("x", "10"), ("x", "abc"), ("x", "")], "g string, v string")
    out = tw.group_by(t, ["g"], [{"operation": "min", "column": "v", "as": "mn"},
                                 {"operation": "max", "column": "v", "as": "mx"}])
    assert rows_of(out) == [("x", "9", "abc")]


def test_global_aggregate(spark):
    t = make_table(spark, [("5",), ("",), (None,)], "price string")
    out = tw.group_by(t, [], [{"operation": "count", "as": "rows"}, {"operation": "sum", "column": "price", "as": "sum_price"},
                              {"operation": "average", "column": "price", "as": "avg_price"}])
    assert rows_of(out) == [(3, 5.0, 5.0)]
    empty = make_table(spark, [], "price string")
    out = tw.group_by(empty, [], [{"operation": "count", "as": "rows"}, {"operation": "sum", "column": "price", "as": "sum_price"}])
    assert rows_of(out) == [(0, None)]


def test_group_errors(spark):
    t = make_table(spark, [("A", "oops")], "category string, price string")
    e = codes(lambda: tw.group_by(t, ["missing"], [{"operation": "count", "as": "count"}]))
    assert e.code == "COLUMN_NOT_FOUND" and e.column == "missing"
    assert codes(lambda: tw.group_by(t, ["category"], [{"operation": "sum", "column": "", "as": "total"}])).code == "INVALID_AGGREGATE"
    e = codes(lambda: tw.group_by(t, ["category"], [{"operation": "count", "as": "category"}]))
    assert e.code == "AGGREGATE_NAME_COLLISION" and e.column == "category"
    out = tw.group_by(t, ["category"], [{"operation": "sum", "column": "price", "as": "total"}])
    e = codes(out.validate)
    assert e.code == "AGGREGATE_NUMERIC_REQUIRED" and e.column == "price"


CLEAN_ROWS = [" A ", "\tB\r\n", "", "   ", " 　C﻿"]


def test_clean_text_trim(spark):
    t = make_table(spark, [(v, f" Row {i} ") for i, v in enumerate(CLEAN_ROWS)], "key string, untouched string")
    out = tw.clean_text(t, ["key"])
    assert [r[0] for r in rows_of(out)] == ["A", "B", "", "", "C"]
    assert [r[1] for r in rows_of(out)] == [f" Row {i} " for i in range(5)]


def test_clean_text_case(spark):
    vals = [" İSTANBUL ", " Straße ", " ＡＢＣ ", " ÉCOLE ", " 日本語 ", "​ A ​"]
    t = make_table(spark, [(v,) for v in vals], "key string")
    out = tw.clean_text(t, ["key"], case_mode="lowercase")
    assert [r[0] for r in rows_of(out)] == ["i̇stanbul", "straße", "ａｂｃ", "école", "日本語", "​ a ​"]
    t2 = make_table(spark, [(" straße ",), (" é ",), (" é ",)], "key string")
    out = tw.clean_text(t2, ["key"], trim=False, case_mode="uppercase")
    assert [r[0] for r in rows_of(out)] == [" STRASSE ", " É ", " É "]


def test_clean_text_errors(spark):
    t = make_table(spark, [], "key string")
    for cols in ([], None, "key"):
        assert codes(lambda: tw.clean_text(t, cols)).code == "INVALID_CLEAN_TEXT"
    e = codes(lambda: tw.clean_text(t, ["missing"]))
    assert e.code == "COLUMN_NOT_FOUND" and e.column == "missing"
    assert codes(lambda: tw.clean_text(t, ["key"], case_mode="titlecase")).code == "INVALID_CLEAN_TEXT"
    assert rows_of(tw.clean_text(t, ["key"])) == []


def test_clean_then_dedup_and_join(spark):
    t = make_table(spark, [(v,) for v in [" Alice ", "ALICE", " Bob "]], "key string")
    clean = tw.clean_text(t, ["key"], case_mode="lowercase")
    dedup = tw.deduplicate_rows(clean, ["key"])
    assert [r[0] for r in rows_of(dedup)] == ["alice", "bob"]
    other = make_table(spark, [("alice", "East"), ("bob", "West")], "id string, region string")
    joined = tw.join_tables(dedup, other, "inner", [{"left": "key", "right": "id"}])
    assert [r[2] for r in rows_of(joined)] == ["East", "West"]


def test_infer_schema(spark):
    rows = [("1", "12.5", "true", "2026-09-01", "2026-09-01T10:20:30Z", "0012", ""),
            ("2", "8", "false", "2026-09-02", "2026-09-02T11:00:00Z", "0013", "ok"),
            ("3", "", "", "", "", "", None)]
    t = make_table(spark, rows, "id string, price string, active string, date string, created_at string, code string, note string")
    s = {c["name"]: c for c in tw.schema_list(t)}
    assert [s[n]["type"] for n in ["id", "price", "active", "date", "created_at", "code", "note"]] == \
        ["integer", "number", "boolean", "date", "timestamp", "string", "string"]
    assert s["note"]["emptyCount"] == 1 and s["note"]["nullCount"] == 1


def test_infer_schema_native_types(spark):
    t = make_table(spark, [(1, {"a": 1}, ["a"], "1"), (2, {"a": 2}, ["b"], "x")],
                   "count long, payload struct<a:long>, tags array<string>, mixed string")
    s = {c["name"]: c["type"] for c in tw.schema_list(t)}
    assert s == {"count": "integer", "payload": "object", "tags": "array", "mixed": "mixed"}


def test_preview_text(spark):
    t = make_table(spark, [(None, "", 1.0, {"b": 2, "a": 1})], "a string, b string, c double, d struct<b:long,a:long>")
    row = tw.preview(t).collect()[0]
    assert tuple(row) == ("NULL", "", "1", '{"b":2,"a":1}')


def test_dedup_map_keys(spark):
    t = make_table(spark, [({"a": 1}, 1), ({"a": 1}, 2), ({"b": 2}, 3)], "m map<string,long>, v long", ordered=False)
    assert sorted(r[1] is not None for r in rows_of(tw.deduplicate_rows(t, ["m"]), ordered=False)) == [True, True]
    assert len(rows_of(tw.deduplicate_rows(t, ["m"]), ordered=False)) == 2
    ordered = make_table(spark, [({"a": 1}, 1), ({"a": 1}, 2), ({"b": 2}, 3)], "m map<string,long>, v long")
    assert [r[1] for r in rows_of(tw.deduplicate_rows(ordered, ["m"]))] == [1, 3]


def test_filter_number_cell_against_text_literal(spark):
    # '01000' is text (leading zero); the number cell 1e3 prints as 1000, which is
    # naturally equal to 01000; dates and plain text do not match.
    t = make_table(spark, [("1e3",), ("abc",), ("2026-01-01",), ("1000.5",)], "s string")
    out = tw.filter_rows(t, [{"column": "s", "operator": "eq", "value": "01000"}])
    assert [r[0] for r in rows_of(out)] == ["1e3"]
