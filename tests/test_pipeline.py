"""Pipelines as data: validation codes, lazy evaluation, documents, recipes, runs."""

import json
import os

import pytest

from tablewright import TableError
from tablewright.plans.pipeline import (evaluate_node, input_nodes, make_recipe, normalize_recipes, parse_pipeline,
                                        preview_node, run_pipeline, sanitize_graph, stringify_pipeline,
                                        validate_pipeline)
from conftest import make_table, rows_of


def node(id, type, **data):
    return {"id": id, "type": type, "position": {"x": 0, "y": 0}, "data": data}


def edge(id, s, sp, t, tp):
    return {"id": id, "source": {"nodeId": s, "portId": sp}, "target": {"nodeId": t, "portId": tp}}


def vertical_slice():
    return {"nodes": [node("input", "csv-input", delimiter="auto", header=True, encoding="utf-8"),
                      node("select", "select-columns", columns=["id", "price"]),
                      node("output", "csv-output", filename="result", delimiter="comma", header=True)],
            "edges": [edge("e1", "input", "table", "select", "in"), edge("e2", "select", "out", "output", "in")]}


def codes(graph):
    return [i["code"] for i in validate_pipeline(graph)["issues"]]


def test_validation_codes():
    assert codes(vertical_slice()) == []
    g = vertical_slice()
    g["edges"] = [e for e in g["edges"] if e["id"] != "e1"]
    assert "REQUIRED_TARGET_PORT" in codes(g)
    g = vertical_slice()
    g["nodes"][1]["data"]["columns"] = []
    assert "NO_COLUMNS" in codes(g)
    g = vertical_slice()
    g["nodes"][2]["data"]["filename"] = " "
    assert "OUTPUT_FILENAME" in codes(g)
    g = vertical_slice()
    g["nodes"].append(node("x", "teleport"))
    assert "UNKNOWN_NODE_TYPE" in codes(g)
    g = vertical_slice()
    g["edges"].append(edge("e3", "ghost", "out", "select", "in"))
    assert {"DANGLING_SOURCE_NODE", "TARGET_CONNECTION_LIMIT"} <= set(codes(g))
    g = vertical_slice()
    g["edges"][1]["target"]["portId"] = "nope"
    assert "MISSING_TARGET_PORT" in codes(g)
    g = vertical_slice()
    g["edges"][1]["source"]["portId"] = "nope"
    assert "MISSING_SOURCE_PORT" in codes(g)
    g = vertical_slice()
    g["nodes"].append(node("s2", "sort", keys=[]))
    g["edges"] += [edge("c1", "select", "out", "s2", "in"), edge("c2", "s2", "out", "select", "in")]
    assert "CYCLE" in codes(g)
    g = vertical_slice()
    g["nodes"][1] = node("select", "clean-text", columns=[])
    assert "CLEAN_TEXT_COLUMNS" in codes(g)
    res = validate_pipeline(g)
    assert res["byNode"]["select"][0]["code"] == "CLEAN_TEXT_COLUMNS" and not res["valid"]


def clean_graph():
    return {"nodes": [node("input", "csv-input"), node("clean", "clean-text", columns=["key"], trim=True, caseMode="lowercase"),
                      node("dedup", "deduplicate", mode="selected", columns=["key"]),
                      node("output", "csv-output", filename="cleaned")],
            "edges": [edge("e1", "input", "table", "clean", "in"), edge("e2", "clean", "out", "dedup", "in"),
                      edge("e3", "dedup", "out", "output", "in")]}


def test_evaluate_clean_dedup(spark):
    t = make_table(spark, [(" Alice ", " Row 0 "), ("ALICE", " Row 1 "), (" Bob ", " Row 2 ")], "key string, untouched string")
    out = evaluate_node(spark, clean_graph(), "dedup", {"input": t})
    assert [r[0] for r in rows_of(out)] == ["alice", "bob"]
    rows, schema = preview_node(spark, clean_graph(), "dedup", {"input": t}, n=1)
    assert [r[0] for r in rows.collect()] == ["alice"] and schema[0]["name"] == "key"
    broken = clean_graph()
    broken["nodes"][1]["data"]["columns"] = ["missing"]
    with pytest.raises(TableError) as e:
        evaluate_node(spark, broken, "clean", {"input": t})
    assert e.value.code == "COLUMN_NOT_FOUND" and e.value.nodeId == "clean"


def test_unbound_other_branch_is_fine(spark):
    g = clean_graph()
    g["nodes"].append(node("other", "parquet-input"))
    g["nodes"].append(node("o2", "parquet-output", filename="x"))
    g["edges"].append(edge("e9", "other", "table", "o2", "in"))
    t = make_table(spark, [("A", "r")], "key string, untouched string")
    assert rows_of(evaluate_node(spark, g, "dedup", {"input": t})) == [("a", "r")]


def test_documents_and_recipes():
    g = {"nodes": [node("in", "csv-input", delimiter="auto", fileName="secret.csv", filename="secret.csv",
                        file={"name": "secret.csv"}), node("out", "csv-output", filename="result")], "edges": []}
    clean = sanitize_graph(g)
    assert "fileName" not in clean["nodes"][0]["data"] and "file" not in clean["nodes"][0]["data"]
    assert clean["nodes"][1]["data"]["filename"] == "result" and g["nodes"][0]["data"]["fileName"] == "secret.csv"
    text = stringify_pipeline(clean, app_version="1.0.0")
    doc = json.loads(text)
    assert doc["schemaVersion"] == 1 and doc["appVersion"] == "1.0.0"
    assert parse_pipeline(text) == clean and parse_pipeline(json.dumps(clean)) == clean
    g2 = {"nodes": [node("x", "sort"), node("csv", "csv-input"), node("jsonl", "jsonl-input"), node("pq", "parquet-input")],
          "edges": []}
    assert [n["id"] for n in input_nodes(g2)] == ["csv", "jsonl", "pq"]
    recipe = make_recipe("Clean keys", clean_graph(), now=5)
    restored = normalize_recipes(json.loads(json.dumps([recipe, {"id": "x"}, {"id": "y", "name": "b", "graph": 3}])))
    assert len(restored) == 1 and restored[0]["graph"]["nodes"][1]["data"]["caseMode"] == "lowercase"


def test_run_writes_every_output(spark, scratch):
    src = os.path.join(scratch, "in.csv")
    open(src, "w").write("id,price,region\n1,10,jp\n2,x,us\n3,30,jp\n")
    g = {"nodes": [node("in", "csv-input", delimiter="auto", header=True),
                   node("cast", "cast", casts=[{"column": "price", "type": "number"}], failureMode="null"),
                   node("group", "group-by", groups=["region"],
                        aggregates=[{"operation": "sum", "column": "price", "as": "total"},
                                    {"operation": "count", "column": "*", "as": "n"}]),
                   node("o1", "csv-output", filename="by region.CSV"),
                   node("o2", "jsonl-output", filename="rows"),
                   node("o3", "parquet-output", filename="rows")],
         "edges": [edge("a", "in", "table", "cast", "in"), edge("b", "cast", "out", "group", "in"),
                   edge("c", "group", "out", "o1", "in"), edge("d", "cast", "out", "o2", "in"),
                   edge("e", "cast", "out", "o3", "in")]}
    out = os.path.join(scratch, "out")
    results = run_pipeline(spark, g, {"in": src}, out, single_file=True)
    assert [(r["filename"], r["rows"], r["columns"]) for r in results] == \
        [("by region.csv", 2, 3), ("rows.jsonl", 3, 3), ("rows.parquet", 3, 3)]
    assert open(os.path.join(out, "by region.csv"), "rb").read() == b"region,total,n\r\njp,40,2\r\nus,,1\r\n"
    assert open(os.path.join(out, "rows.jsonl")).read().splitlines()[1] == '{"id":"2","price":null,"region":"us"}'
    strict = json.loads(json.dumps(g))
    strict["nodes"][1]["data"]["failureMode"] = "error"
    with pytest.raises(TableError) as e:
        run_pipeline(spark, strict, {"in": src}, out)
    assert e.value.code == "CAST_FAILED" and e.value.value == "x"


# -- previews that read no more than they need ---------------------------------------------------

def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)
    return folder


def csv_chain(*kinds):
    nodes = [node("in", "csv-input", delimiter="comma", header=True), *kinds]
    return {"nodes": nodes, "edges": [edge(f"e{i}", a["id"], "table" if i == 0 else "out", b["id"], "in")
                                      for i, (a, b) in enumerate(zip(nodes, nodes[1:]))]}


def test_preview_of_many_files_reads_the_first(spark, scratch):
    folder = os.path.join(scratch, "many files")
    for i in range(200):
        put(folder, f"{i:03d}.csv", "a,b\n" + "".join(f"{i},{k}\n" for k in range(120)) + ("1,2,3\n" if i == 30 else ""))
    g = csv_chain(node("cast", "cast", casts=[{"column": "b", "type": "integer"}]))
    rows, schema = preview_node(spark, g, "cast", {"in": folder})
    assert [tuple(r) for r in rows.collect()] == [("0", str(k)) for k in range(100)] and [c["type"] for c in schema] == ["integer", "integer"]
    assert rows.inputFiles() == [] or not any("many" in f for f in rows.inputFiles())
    few = csv_chain(node("some", "filter-rows", conditions=[{"column": "b", "operator": "eq", "value": "5"}], combination="and"))
    with pytest.raises(TableError) as e:  # 100 such rows lie in 100 files, the bad one among them
        preview_node(spark, few, "some", {"in": folder})
    assert e.value.code == "CSV_ROW_WIDTH"
    rows = preview_node(spark, few, "some", {"in": folder}, n=5)[0]
    assert [tuple(r) for r in rows.collect()] == [(str(i), "5") for i in range(5)]


def test_preview_raises_for_bad_rows_that_it_reads(spark, scratch):
    folder = put(os.path.join(scratch, "bad"), "1.csv", "a,b\n1,2,3\n")
    with pytest.raises(TableError) as e:
        preview_node(spark, csv_chain(node("cut", "select-columns", columns=["a"])), "cut", {"in": folder})
    assert e.value.code == "CSV_ROW_WIDTH" and e.value.value == "1,2,3"
    put(os.path.join(scratch, "late"), "1.csv", "a\n1\n")
    late = put(os.path.join(scratch, "late"), "2.csv", "a,c\n2,x\n")
    rows = preview_node(spark, csv_chain(node("cut", "select-columns", columns=["c"])), "cut", {"in": late})[0]
    assert [tuple(r) for r in rows.collect()] == [("NULL",), ("x",)]
    empty = put(os.path.join(scratch, "none"), "1.csv", "")
    assert preview_node(spark, csv_chain(node("l", "limit", limit=3)), "in", {"in": empty})[0].count() == 0


# -- several outputs of one run ---------------------------------------------------------------------

def fan():
    join = node("j", "join", keys=[{"left": "k", "right": "k"}])
    join["data"]["type"] = "left"
    return {"nodes": [node("l", "parquet-input"), node("r", "parquet-input"), join,
                      node("big", "filter-rows", conditions=[{"column": "v", "operator": "gte", "value": 5}], combination="and"),
                      node("o1", "parquet-output", filename="all"), node("o2", "csv-output", filename="big"), node("o3", "jsonl-output", filename="json")],
            "edges": [edge("a", "l", "table", "j", "left"), edge("b", "r", "table", "j", "right"), edge("c", "j", "out", "o1", "in"),
                      edge("d", "j", "out", "big", "in"), edge("e", "big", "out", "o2", "in"), edge("f", "big", "out", "o3", "in")]}


def test_outputs_of_one_join_read_its_inputs_once(spark, scratch):
    from tablewright.plans.pipeline import Evaluator
    spark.range(10).selectExpr("id as k", "id as v").write.parquet(os.path.join(scratch, "l"))
    spark.range(5).selectExpr("id as k", "cast(id as string) as `a b`").write.parquet(os.path.join(scratch, "r"))
    inputs = {n: os.path.join(scratch, n) for n in "lr"}
    ev = Evaluator(spark, fan(), inputs)
    ev.share()
    assert ev.staged == {"j"}
    assert not any(f.startswith(f"file://{scratch}") for f in ev.table("o2").df.inputFiles())
    done = {r["nodeId"]: r for r in run_pipeline(spark, fan(), inputs, os.path.join(scratch, "out"), node_counts=True)}
    assert {n: r["rows"] for n, r in done.items()} == {"o1": 10, "o2": 5, "o3": 5}
    counts = done["o1"]["nodeRows"]
    assert counts["l"]["out"] == 10 and counts["r"]["out"] == 5 and counts["j"] == {"in": [10, 5], "out": 10}
    assert counts["big"] == {"in": [10], "out": 5} and counts["o3"] == {"in": [5], "out": 5}


def test_row_local_branches_are_not_staged(spark):
    from tablewright.plans.pipeline import Evaluator
    g = fan()
    g["nodes"][2] = node("j", "union", inputCount=2)
    g["edges"][0]["target"]["portId"], g["edges"][1]["target"]["portId"] = "in1", "in2"
    ev = Evaluator(spark, g, {})
    ev.share()
    assert ev.staged == set()


def test_a_failing_shared_node_is_named(spark, scratch):
    t = make_table(spark, [(1, "x")], "k int, v string", ordered=False)
    g = fan()
    g["nodes"].insert(3, node("c", "cast", casts=[{"column": "v", "type": "integer"}]))
    g["edges"][2:4] = [edge("c", "j", "out", "c", "in"), edge("g", "c", "out", "o1", "in"), edge("d", "c", "out", "big", "in")]
    with pytest.raises(TableError) as e:
        run_pipeline(spark, g, {"l": t, "r": make_table(spark, [(2,)], "k int", ordered=False)}, scratch)
    assert e.value.code == "CAST_FAILED" and e.value.nodeId == "c" and os.listdir(scratch) == []
