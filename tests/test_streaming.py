"""Recipe over arriving files with Structured Streaming (row-local nodes only)."""

import glob
import os

import pytest

from tablewright import TableError
from tablewright.sources.text import read_csv
from tablewright.streaming.recipes import run_recipe_on_arrivals
from conftest import rows_of


def node(id, kind, **data):
    return {"id": id, "type": kind, "position": {"x": 0, "y": 0}, "data": data}


def edge(id, s, sp, t, tp):
    return {"id": id, "source": {"nodeId": s, "portId": sp}, "target": {"nodeId": t, "portId": tp}}


def graph(middle):
    nodes = [node("in", "csv-input", delimiter="comma", header=True), middle, node("out", "csv-output", filename="o")]
    return {"nodes": nodes, "edges": [edge("a", "in", "table", middle["id"], "in"), edge("b", middle["id"], "out", "out", "in")]}


def test_stream_clean_text(spark, scratch):
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox)
    open(os.path.join(inbox, "jan.csv"), "w").write("key,n\n Alice ,1\nBOB,\n")
    open(os.path.join(inbox, "feb.csv"), "w").write("key,n\n carol,3\n")
    g = graph(node("clean", "clean-text", columns=["key"], trim=True, caseMode="lowercase"))
    out = os.path.join(scratch, "out")
    q = run_recipe_on_arrivals(spark, g, "out", inbox, out, checkpoint=os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    batches = glob.glob(os.path.join(out, "batch-*"))
    assert batches
    back = read_csv(spark, batches, delimiter=",")
    assert sorted(rows_of(back, ordered=False)) == [("alice", "1"), ("bob", ""), ("carol", "3")]


def test_stream_refuses_global_nodes(spark, scratch):
    inbox = os.path.join(scratch, "inbox2")
    os.makedirs(inbox)
    open(os.path.join(inbox, "a.csv"), "w").write("key\nx\n")
    g = graph(node("dedup", "deduplicate", mode="all"))
    with pytest.raises(TableError) as e:
        run_recipe_on_arrivals(spark, g, "out", inbox, os.path.join(scratch, "o2"))
    assert e.value.code == "STREAM_UNSUPPORTED"


def arrivals(spark, scratch, g, name, text):
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox, exist_ok=True)
    with open(os.path.join(inbox, name), "w") as f:
        f.write(text)
    query = run_recipe_on_arrivals(spark, g, "out", inbox, os.path.join(scratch, "out"), checkpoint=os.path.join(scratch, "ck"))
    query.awaitTermination(120)
    return query


def jsonl_graph():
    return {"nodes": [node("in", "jsonl-input"), node("out", "jsonl-output", filename="o")], "edges": [edge("a", "in", "table", "out", "in")]}


def test_the_first_batch_sets_the_columns(spark, scratch):
    from tablewright.sources.text import read_jsonl
    arrivals(spark, scratch, jsonl_graph(), "one file.jsonl", '{"a":1.5,"b":"x"}\n')
    arrivals(spark, scratch, jsonl_graph(), "2.jsonl", '{"a":2}\n')
    back = read_jsonl(spark, glob.glob(os.path.join(scratch, "out", "batch-*")))
    assert back.columns == ["a", "b"] and sorted(rows_of(back, ordered=False), key=str) == [(1.5, "x"), (2.0, None)]
    for name, text, code in (("3.jsonl", '{"a":3,"c":1}\n', "STREAM_NEW_COLUMN"),):
        with pytest.raises(Exception, match="the column c"):
            arrivals(spark, scratch, jsonl_graph(), name, text)
    assert len(glob.glob(os.path.join(scratch, "out", "batch-*"))) == 2


def test_a_changed_type_stops_the_stream(spark, scratch):
    arrivals(spark, scratch, jsonl_graph(), "1.jsonl", '{"a":1}\n')
    with pytest.raises(Exception, match="was bigint and is string"):
        arrivals(spark, scratch, jsonl_graph(), "2.jsonl", '{"a":"x"}\n')


def test_the_stream_reads_no_content(spark, scratch):
    from tablewright.streaming.recipes import FILE_COLUMNS
    os.makedirs(os.path.join(scratch, "f"))
    open(os.path.join(scratch, "f", "a"), "w").write("x")
    plan = spark.read.format("binaryFile").schema(FILE_COLUMNS).load(os.path.join(scratch, "f")).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
