"""CSV records with line breaks in cells, read in many splits."""

import csv
import os
import random

import pytest
from conftest import rows_of

from tablewright.errors import TableError
from tablewright.sources.records import Reading, line_state
from tablewright.sources.text import csv_rejects, read_csv


def some_rows(n, seed):
    r = random.Random(seed)
    cell = lambda: r.choice(["a", "", "b,c", 'say "hi"', "x\ny", '"', '\n"\n', "two\n\nlines", "é", "5 \" x", ","])
    return [[str(i), cell(), cell()] for i in range(n)]


def write(path, rows, newline):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(["id", "first\nname", "x"])
        out.writerows(rows)


@pytest.mark.parametrize("newline,split", [("\n", 64), ("\r\n", 150), ("\n", 1 << 27)])
def test_records_cross_splits(spark, scratch, newline, split):
    rows = some_rows(150, split)
    for k in range(2):
        write(os.path.join(scratch, f"{k} file.csv"), rows[75 * k:75 * k + 75], newline)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        t = read_csv(spark, scratch, delimiter="comma", multi_line=True, keep_order=True, carry=True)
        assert t.columns == ["id", "first\nname", "x"]
        assert [list(r) for r in rows_of(t)] == rows
        if split == 64:
            assert t.df.rdd.getNumPartitions() > 10
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_quote_left_open_is_reported(spark, scratch):
    path = os.path.join(scratch, "open.csv")
    with open(path, "w") as f:
        f.write('a,b\n1,"x\ny"\n2,"never\nclosed\n')
    assert [(r.reason, r.text) for r in csv_rejects(spark, path, delimiter="comma", multi_line=True).collect()] == [("CSV_OPEN_QUOTE", '2,"never\nclosed')]
    with pytest.raises(TableError):
        read_csv(spark, path, delimiter="comma", multi_line=True).validate()


def test_a_block_is_a_function_of_its_start():
    after = line_state(",")
    lines = ['a,"b', 'c",d', "", '"x""y",z', '5" pipe', 'q,"open', "", 'more']
    out, inside = Reading(after, False, True), Reading(after, True, True)
    for i, line in enumerate(lines):
        out.take(line, i)
        inside.take(line, i)
    assert [w for w in out.whole] == [(0, 'a,"b\nc",d'), (3, '"x""y",z'), (4, '5" pipe')]
    assert out.borders() == (True, None, 'q,"open\n\nmore', 5, 3)
    assert inside.borders()[1].startswith('a,"b') and not after("x", False) and after("x", True)
