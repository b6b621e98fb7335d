"""Sources and sinks: golden bytes, JSONL rules, delimiter detection, round trips."""

import datetime as dt
import glob
import hashlib
import os

import pytest

import tablewright as tw
from tablewright import TableError
from tablewright.sinks.files import output_filename, write_csv, write_jsonl, write_parquet
from tablewright.sources.parquet import read_parquet
from tablewright.sources.text import detect_delimiters, jsonl_rejects, read_csv, read_jsonl, score_delimiters
from conftest import make_table, rows_of

# Golden digests of the reference's outputs for rows (1, '日本語'), (2, ''), (3, null).
GOLDEN = {"csv": "063826d785dcaeccbb5fc650515d22c0ff54a338470a4588562e5ac4686b5c1f",
          "jsonl": "113b331853e6430f54de5d6da95203541456fed8926067dd0d3cc9a0befbaac4"}


def sha(path):
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def golden_table(spark):
    return make_table(spark, [(1, "日本語"), (2, ""), (3, None)], "id int, label string")


def test_golden_csv(spark, scratch):
    out = os.path.join(scratch, "report.csv")
    write_csv(golden_table(spark), out, single_file=True)
    assert open(out, "rb").read() == "id,label\r\n1,日本語\r\n2,\r\n3,\r\n".encode()
    assert sha(out) == GOLDEN["csv"]


def test_golden_jsonl(spark, scratch):
    out = os.path.join(scratch, "report.jsonl")
    write_jsonl(golden_table(spark), out, single_file=True)
    assert sha(out) == GOLDEN["jsonl"], open(out, "rb").read()


def test_jsonl_output_types(spark, scratch):
    t = make_table(spark, [(1, "Alice", dt.datetime(2026, 9, 17, 1, 2, 3), None),
                           (2, "Bob", None, 12.5)], "id long, name string, created timestamp_ntz, amount double")
    out = os.path.join(scratch, "o.jsonl")
    write_jsonl(t, out, single_file=True, bigint_as_text=True)
    assert open(out, encoding="utf-8").read() == (
        '{"id":"1","name":"Alice","created":"2026-09-17T01:02:03.000Z","amount":null}\n'
        '{"id":"2","name":"Bob","created":null,"amount":12.5}\n')


def test_csv_quoting_and_multipart(spark, scratch):
    t = make_table(spark, [("a,b", 'say "hi"'), ("line\nbreak", "x")], "p string, q string")
    out = os.path.join(scratch, "q.csv")
    write_csv(t, out, single_file=True)
    assert open(out, "rb").read() == b'p,q\r\n"a,b","say ""hi"""\r\n"line\nbreak",x\r\n'
    parts = os.path.join(scratch, "parts")
    write_csv(t, parts)
    files = sorted(glob.glob(os.path.join(parts, "part-*")))
    assert files and all(open(f, "rb").read().startswith(b"p,q\r\n") for f in files)
    back = read_csv(spark, parts, delimiter=",", multi_line=True)
    assert sorted(rows_of(back, ordered=False)) == sorted([("a,b", 'say "hi"'), ("line\nbreak", "x")])


def test_output_filenames():
    cases = [("report", "report.csv"), ("report.CsV", "report.csv"), ("report.JsOnL", "report.csv"),
             ("report.PARQUET", "report.csv"), ("quarter.csv.backup", "quarter.csv.backup.csv"),
             ("日本語.2026", "日本語.2026.csv"), ("", "output.csv"), ("   ... ", "output.csv"), (".csv", "output.csv"),
             (' sales<>:"/\\|?*\u0000. ', "sales----------.csv"), ("x" * 140 + ".JSONL", "x" * 120 + ".csv")]
    for name, expected in cases:
        assert output_filename(name, "csv") == expected, name
    assert output_filename("report", "parquet") == "report.parquet"


def test_delimiter_scoring():
    assert score_delimiters('name;note;value\nAlice;"hello, world";1\nBob;"x,y";2\n') == ";"
    assert score_delimiters("id\tname\n1\tAlice\n2\tBob\n") == "\t"
    assert score_delimiters("just one column\nno delimiters\n") == ","


def test_delimiter_folder(spark, scratch):
    folder = os.path.join(scratch, "mixed")
    os.makedirs(folder)
    open(os.path.join(folder, "a.csv"), "w").write("id,name\n1,Alice\n2,Bob\n")
    open(os.path.join(folder, "b.tsv"), "w").write("id\tname\n3\tCarol\n")
    open(os.path.join(folder, "c.txt"), "w").write('id;name\n4;"D, E"\n')
    found = {os.path.basename(r["file"]): r["delimiter"] for r in detect_delimiters(spark, folder).collect()}
    assert found == {"a.csv": ",", "b.tsv": "\t", "c.txt": ";"}
    t = read_csv(spark, folder)
    assert t.columns == ["id", "name"]
    assert sorted(rows_of(t, ordered=False)) == [("1", "Alice"), ("2", "Bob"), ("3", "Carol"), ("4", "D, E")]


def test_csv_blank_cells_bom_and_order(spark, scratch):
    path = os.path.join(scratch, "f.csv")
    open(path, "w", encoding="utf-8").write("﻿id,商品名,note\n1,りんご,\n2,\"\",x\n3,みかん\n")
    t = read_csv(spark, path, delimiter="comma", keep_order=True)
    assert t.columns == ["id", "商品名", "note"]
    assert rows_of(t) == [("1", "りんご", ""), ("2", "", "x"), ("3", "みかん", "")]
    dup = os.path.join(scratch, "d.csv")
    open(dup, "w").write("a,a\n1,2\n")
    with pytest.raises(TableError) as e:
        read_csv(spark, dup, delimiter=",")
    assert e.value.code == "COLUMN_NAME_COLLISION"
    nohead = read_csv(spark, dup, delimiter=",", header=False, keep_order=True)
    assert nohead.columns == ["column_1", "column_2"] and rows_of(nohead) == [("a", "a"), ("1", "2")]


def test_jsonl_key_union(spark, scratch):
    path = os.path.join(scratch, "k.jsonl")
    open(path, "w").write('{"id":1,"name":"Alice"}\n\n{"id":2,"active":true}\n')
    t = read_jsonl(spark, path, keep_order=True)
    assert t.columns == ["id", "name", "active"]
    assert rows_of(t) == [(1, "Alice", None), (2, None, True)]


def test_jsonl_errors(spark, scratch):
    path = os.path.join(scratch, "bad.jsonl")
    open(path, "w").write('{"id":1}\nnot-json\n[1,2]\n')
    with pytest.raises(TableError) as e:
        read_jsonl(spark, path)
    assert e.value.code == "JSONL_PARSE" and e.value.line == 2
    rejects = sorted((r["line"], r["reason"]) for r in jsonl_rejects(spark, path).collect())
    assert rejects == [(2, "JSONL_PARSE"), (3, "JSONL_OBJECT")]
    lenient = read_jsonl(spark, path, strict=False)
    assert rows_of(lenient, ordered=False) == [(1,)]


def test_parquet_round_trip_and_nested(spark, scratch):
    t = make_table(spark, [(1, 12.5, True, "Alice"), (2, None, False, "Bob"), (None, 4.25, None, None)],
                   "id int, price double, active boolean, name string")
    out = os.path.join(scratch, "t.parquet")
    write_parquet(t, out)
    back = read_parquet(spark, out)
    assert back.columns == ["id", "price", "active", "name"]
    assert sorted(rows_of(back, ordered=False), key=str) == sorted(rows_of(t), key=str)
    nested = make_table(spark, [([1.0],)], "v array<double>")
    npath = os.path.join(scratch, "n.parquet")
    write_parquet(nested, npath)
    with pytest.raises(TableError) as e:
        read_parquet(spark, npath)
    assert e.value.code == "PARQUET_NESTED"
