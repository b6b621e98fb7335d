"""Inputs that don't fit: nothing is dropped or mislabelled without an error."""

import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import tablewright as tw
from tablewright import TableError
from tablewright.functions import sniff as S
from tablewright.operators.profile import infer_schema
from tablewright.plans.pipeline import run_pipeline, schema_issues, validate_pipeline
from tablewright.session import ensure_checkpoint_dir
from tablewright.sinks.files import write_csv
from tablewright.sources.parquet import read_parquet
from tablewright.sources.text import csv_rejects, jsonl_rejects, read_csv, read_jsonl
from tablewright.streaming.recipes import run_recipe_on_arrivals
from conftest import make_table, rows_of


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def failed(table):
    with pytest.raises(TableError) as e:
        table.validate()
    return e.value.code


def test_long_rows_are_errors(spark, scratch):
    path = put(scratch, "long.csv", 'a,b\n1,2,3,4\n5\n"x,y",6\n')
    t = read_csv(spark, path)
    assert failed(t) == "CSV_ROW_WIDTH"
    assert [tuple(r)[1:] for r in csv_rejects(spark, path).collect()] == [("CSV_ROW_WIDTH", "1,2,3,4")]
    assert ("5", "") in rows_of(t, ordered=False) and ("x,y", "6") in rows_of(t, ordered=False)


def test_files_with_other_headers_unite_by_name(spark, scratch):
    put(scratch, "m/1.csv", "a,b\n1,2\n")
    put(scratch, "m/2.csv", "b,a\n3,4\n")
    put(scratch, "m/3.csv", "a;b;c\n5;6;7\n")
    t = read_csv(spark, os.path.join(scratch, "m"))
    t.validate()
    assert t.columns == ["a", "b", "c"]
    assert sorted(rows_of(t, ordered=False)) == [("1", "2", None), ("4", "3", None), ("5", "6", "7")]


def test_quoted_newlines_need_multi_line(spark, scratch):
    path = put(scratch, "q.csv", 'a,b\n"x\ny",2\n5" pipe,3\n')
    assert failed(read_csv(spark, path)) == "CSV_OPEN_QUOTE"
    t = read_csv(spark, path, multi_line=True)
    t.validate()
    assert sorted(rows_of(t, ordered=False)) == [('5" pipe', "3"), ("x\ny", "2")]
    assert failed(read_csv(spark, put(scratch, "q2.csv", 'a,b\n"x\ny",2,3\n'), multi_line=True)) == "CSV_ROW_WIDTH"


def test_one_column_keeps_empty_cells(spark, scratch):
    t = make_table(spark, [("x",), (None,), ("",), ("y",)], "c string")
    path = os.path.join(scratch, "one")
    assert write_csv(t, path) == 4
    assert [r[0] for r in rows_of(read_csv(spark, path, keep_order=True))] == ["x", "", "", "y"]
    empty = make_table(spark, [], "c string")
    assert write_csv(empty, os.path.join(scratch, "none")) == 0
    assert read_csv(spark, os.path.join(scratch, "none")).columns == ["c"]


LINES = ['{"a":1}', '{"a":2} trailing', '{"a":3}{"a":4}', "[1]", "5", '{"b":{"c":1.5}}', "", '{"a":1},{"a":2}', '{"a":"x","d":[1,2]}', "null", "x"]


def test_jsonl_lines_with_more_than_one_value(spark, scratch):
    path = put(scratch, "j.jsonl", "\n".join(LINES) + "\n")
    bad = {(r["line"], r["reason"]) for r in jsonl_rejects(spark, path).collect()}
    assert bad == {(2, "JSONL_PARSE"), (3, "JSONL_PARSE"), (4, "JSONL_OBJECT"), (5, "JSONL_OBJECT"), (8, "JSONL_PARSE"),
                   (10, "JSONL_OBJECT"), (11, "JSONL_PARSE")}
    with pytest.raises(TableError) as e:
        read_jsonl(spark, path)
    assert e.value.code == "JSONL_PARSE" and e.value.line == 2
    t = read_jsonl(spark, path, strict=False)
    assert t.schema.simpleString() == "struct<a:string,b:struct<c:double>,d:array<bigint>>"
    assert [r[0] for r in rows_of(t, ordered=False)] == ["1", None, "x"]


def test_jsonl_odd_keys(spark, scratch):
    path = put(scratch, "k.jsonl", '{"a b":1,"x`y":"t"}\n{"é.z":2.5,"a b":3}\n{"d":1,"d":2}\n')
    t = read_jsonl(spark, path)
    assert t.columns == ["a b", "x`y", "é.z", "d"]
    assert rows_of(t, ordered=False)[0][0] == 1 and t.dtype("é.z").simpleString() == "double"


def test_parquet_values(spark, scratch):
    u = uuid.UUID("12345678-1234-5678-1234-567812345678")
    table = pa.table({"t": pa.array([1700000000123456789], pa.timestamp("ns")), "b": pa.array([b"abc"], pa.binary()),
                      "f": pa.array([u.bytes], pa.binary(16))})
    pq.write_table(table, os.path.join(scratch, "v.parquet"), version="2.6")
    row = read_parquet(spark, os.path.join(scratch, "v.parquet")).df.collect()[0]
    assert row["t"].microsecond == 123456 and row["b"] == "abc" and row["f"] == u.hex


def test_file_order_over_several_files(spark, scratch):
    for i, name in enumerate(("b", "a", "c")):
        pq.write_table(pa.table({"n": [f"{name}{k}" for k in range(3 + i)]}), os.path.join(scratch, f"{name}.parquet"))
    t = read_parquet(spark, [os.path.join(scratch, f"{n}.parquet") for n in "cab"], keep_order=True)
    got = [r[0] for r in rows_of(t)]
    assert got == sorted(got) and len(got) == 12


@pytest.mark.parametrize("a,b", [("x2", "x10"), ("x9" * 20, "x" + "9" * 45), ("x" + "1" * 40, "x" + "1" * 45), ("n007", "n8")])
def test_natural_order_of_long_runs(spark, a, b):
    df = spark.createDataFrame([(b,), (a,)], "c string")
    first = df.orderBy(S.natural_key(df.c)).collect()
    assert S.natural_key_py(a) < S.natural_key_py(b) and [r[0] for r in first] == [a, b]


def test_integers_beyond_doubles(spark):
    t = make_table(spark, [(9007199254740992,), (9007199254740993,), (None,)], "n long")
    pick = lambda op, v: [r[0] for r in rows_of(tw.filter_rows(t, [{"column": "n", "operator": op, "value": v}]))]
    for value in ("9007199254740993", 9007199254740993):
        assert pick("eq", value) == [9007199254740993] and pick("lt", value) == [9007199254740992]
    assert pick("gt", 9007199254740992.0) == [9007199254740993]
    assert pick("lt", 2 ** 70) == [9007199254740992, 9007199254740993] and pick("gt", 1e300) == []
    small = make_table(spark, [(3,), (4,)], "n int")
    some = lambda op, v: [r[0] for r in rows_of(tw.filter_rows(small, [{"column": "n", "operator": op, "value": v}]))]
    assert some("gte", 3.5) == [4] and some("lte", "3.5") == [3] and some("eq", 3.5) == [] and some("neq", 3.5) == [3, 4]


def test_boundary_cells_in_null_mode(spark):
    cells = ["-9223372036854775808", "9007199254740991", "9007199254740992", "0x" + "f" * 30, "1e400", ""]
    t = make_table(spark, [(c, c, -2 ** 63) for c in cells], "i string, n string, b long")
    out = tw.cast_columns(t, [{"column": c, "type": k} for c, k in (("i", "integer"), ("n", "number"), ("b", "integer"))], "null")
    assert rows_of(out) == [(None, -9223372036854775808.0, None), (9007199254740991, 9007199254740991.0, None),
                            (None, 9007199254740992.0, None), (None, None, None), (None, None, None), (None, None, None)]


@pytest.mark.parametrize("width", [30, 100])
def test_profile_of_wide_tables(spark, width):
    df = spark.range(50).selectExpr(*[f"cast(id + {i} as string) as c{i}" for i in range(width)])
    rows = infer_schema(df).collect()
    assert len(rows) == width and {r["type"] for r in rows} == {"integer"} and {r["observedCount"] for r in rows} == {50}
    assert {r["type"] for r in infer_schema(df.limit(0)).collect()} == {"string"}


def node(id, kind, **data):
    return {"id": id, "type": kind, "position": {"x": 0, "y": 0}, "data": data}


def edge(id, s, sp, t, tp):
    return {"id": id, "source": {"nodeId": s, "portId": sp}, "target": {"nodeId": t, "portId": tp}}


def two_outputs(kind, **data):
    return {"nodes": [node("in", "parquet-input"), node("step", kind, **data), node("o1", "csv-output", filename="same"),
                      node("o2", "csv-output", filename="Same.csv")],
            "edges": [edge("a", "in", "table", "step", "in"), edge("b", "step", "out", "o1", "in"), edge("c", "step", "out", "o2", "in")]}


def test_outputs_may_not_share_a_file(spark, scratch):
    g = two_outputs("limit", limit=1)
    assert [i["code"] for i in validate_pipeline(g)["issues"]] == ["OUTPUT_NAME_COLLISION"]
    with pytest.raises(TableError):
        run_pipeline(spark, g, {}, scratch)


def test_settings_are_checked_against_columns(spark):
    g = two_outputs("sort", keys=[{"column": "gone"}])
    g["nodes"][3]["data"]["filename"] = "other"
    t = make_table(spark, [(1,)], "here int")
    assert [(i["code"], i["nodeId"]) for i in schema_issues(spark, g, {"in": t})] == [("COLUMN_NOT_FOUND", "step")]


def test_a_table_joined_to_itself_has_one_check(spark):
    t = tw.cast_columns(make_table(spark, [("1",), ("x",)], "k string"), [{"column": "k", "type": "integer"}])
    both = tw.join_tables(t, t, "inner", [{"left": "k", "right": "k"}])
    assert len(both.checks) == 1


def test_stream_reads_each_batch_like_a_batch_run(spark, scratch):
    inbox = os.path.join(scratch, "inbox")
    put(inbox, "1.csv", "id;name\n1;a\n")
    put(inbox, "2.csv", "name,id\nb,2\n")
    g = {"nodes": [node("in", "csv-input", delimiter="auto", header=True), node("cut", "select-columns", columns=["id", "name"]),
                   node("out", "csv-output", filename="o")],
         "edges": [edge("a", "in", "table", "cut", "in"), edge("b", "cut", "out", "out", "in")]}
    out = os.path.join(scratch, "out")
    run_recipe_on_arrivals(spark, g, "out", inbox, out, checkpoint=os.path.join(scratch, "ck")).awaitTermination(120)
    assert sorted(rows_of(read_csv(spark, os.path.join(out, "batch-000000")), ordered=False)) == [("1", "a"), ("2", "b")]
    lines = os.path.join(scratch, "lines")
    put(lines, "1.jsonl", '{"a":1}\nnot json\n')
    h = {"nodes": [node("in", "jsonl-input"), node("out", "jsonl-output", filename="o")], "edges": [edge("a", "in", "table", "out", "in")]}
    with pytest.raises(Exception, match="JSONL|JSON"):
        run_recipe_on_arrivals(spark, h, "out", lines, os.path.join(scratch, "o2"), checkpoint=os.path.join(scratch, "ck2")).awaitTermination(120)


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


@pytest.mark.parametrize("size", [3_000, 100_000, 10_000_000])
def test_long_jsonl_lines(spark, scratch, size):
    path = put(scratch, "long.jsonl", '{"a":1,"b":"' + "x" * size + '"}\n"' + "y" * size + '"\n')
    assert [(r.line, r.reason) for r in jsonl_rejects(spark, path).collect()] == [(2, "JSONL_OBJECT")]
    with pytest.raises(TableError) as e:
        read_jsonl(spark, path)
    assert e.value.code == "JSONL_OBJECT" and e.value.line == 2
    t = read_jsonl(spark, path, strict=False)
    assert t.df.selectExpr("a", "length(b)").collect() == [(1, size)]


def test_lines_that_close_the_parser_early(spark, scratch):
    lines = ['{"a":1}] x', '{"a":1}],[2', '{"a":1}}', '{"v":1},"m"]', '{"z":1}', '{"b":[1,2],"a":2}']
    path = put(scratch, "odd.jsonl", "\n".join(lines) + "\n")
    assert sorted((r.line, r.reason) for r in jsonl_rejects(spark, path).collect()) == [(i, "JSONL_PARSE") for i in (1, 2, 3, 4)]
    t = read_jsonl(spark, path, strict=False)
    assert t.columns == ["z", "b", "a"] and rows_of(t, ordered=False) == [(1, None, None), (None, [1, 2], 2)]


def test_long_quoted_csv_cell(spark, scratch):
    path = put(scratch, "long.csv", 'a,b\n1,"' + 'x""' * 200_000 + '"\n')
    t = read_csv(spark, path, delimiter="comma").validate()
    assert t.df.selectExpr("length(b)").first()[0] == 400_000


def test_each_jsonl_plan_parses_a_line_twice_at_most(spark, scratch):
    path = put(scratch, "p.jsonl", '{"a":1,"b":"x"}\n')
    plan = read_jsonl(spark, path).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.lower().count("parse_json") == 1
    rejects = read_jsonl(spark, path, strict=False).df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert rejects.count("parse_json") + rejects.count("from_json") + rejects.count("jsontostructs") <= 3


def test_text_behind_a_closing_quote_is_an_error(spark, scratch):
    path = put(scratch, "behind.csv", 'a,b\n"x" ,2\n"""x",1\n5" pipe,3\n"a"b,4\n"q,""r""",5\n')
    assert sorted((r.reason, r.text) for r in csv_rejects(spark, path, delimiter="comma").collect()) == [
        ("CSV_QUOTE_TEXT", '"a"b,4'), ("CSV_QUOTE_TEXT", '"x" ,2')]
    good = put(scratch, "good.csv", 'a,b\n"""x",1\n5" pipe,3\n"q,""r""",5\na,b\n')
    t = read_csv(spark, good, delimiter="comma").validate()
    assert sorted(rows_of(t, ordered=False)) == [('"x', "1"), ('5" pipe', "3"), ("a", "b"), ('q,"r"', "5")]


def test_csv_rows_are_judged_in_the_write(spark, scratch):
    from tablewright.sinks.files import write_parquet
    path = put(scratch, "wide.csv", "a,b\n1,2\n1,2,3\n")
    with pytest.raises(TableError) as e:
        write_parquet(read_csv(spark, path, carry=True), os.path.join(scratch, "out"))
    assert e.value.code == "CSV_ROW_WIDTH" and e.value.value == "1,2,3" and not os.path.exists(os.path.join(scratch, "out"))
    plan = read_csv(spark, put(scratch, "fine.csv", "a,b\n1,2\n"), carry=True).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
