"""Edges of the trade course move with numbers, and only once their ends are known."""

import datetime
import os
import re

import pytest

from lectern.functions.text import SPACE, strip
from lectern.operators.concept_graph import build_edges
from lectern.plans import trade

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_stated_where_lines_are(spark):
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables aren't here")
    course = trade.Course(spark, DATA)
    assert "Exchange" not in plan(course.stated) and course.stated.count() > 0


def test_numbers_are_gathered_without_sorting(spark):
    rows = [("c", 5, "a", "b", (1, 2)), ("c", 9, "a", "b", (3, 4)), ("c", 7, "a", "b", (5, 6))]
    edges = spark.createDataFrame(rows, "spec string, seq long, from string, to string, told struct<x:long,y:long>")
    found = build_edges(edges, None, ["told.x"], ["told.y"])
    assert [tuple(r) for r in found.collect()] == [("c", "a", "b", 3, 2, 5)]
    assert "SortAggregate" not in plan(found) and "HashAggregate" in plan(found)


def test_lines_of_one_number(spark, tmp_path):
    day = datetime.date(1996, 2, 20)
    numbers = {1: [1, 2, 2, 3, None, None], 2: [4, 2, 1, 1], 3: [7]}
    lines = [(o, n, p, 1, 5.0, 1.0, 0.0, 0.02, "N", "O", day) for o, ns in numbers.items() for p, n in enumerate(ns)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"),
        "orders": ([(o, day) for o in numbers], "o_orderkey long, o_orderdate date"),
        "part": ([(p, f"part {p}", "b", "t", p) for p in range(6)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = trade._edges(trade.by_order(spark, str(tmp_path))).collect()
    want = []
    for o, ns in numbers.items():
        own = sorted(((n, p) for p, n in enumerate(ns) if n is not None))
        pairs = [(a, b) for a in own for b in own if b[0] == a[0] + 1]
        want += [(o, i, f"part {a[1]} {a[1]}", f"part {b[1]} {b[1]}") for i, (a, b) in enumerate(pairs)]
    assert sorted((r.l_orderkey, r.i, r["from"], r["to"]) for r in found) == sorted(want)


def test_strip_knows_every_space(spark):
    kept = [c for c in map(chr, range(1, 0xFFFF)) if not 0xD800 <= ord(c) < 0xE000]
    df = spark.createDataFrame([(c,) for c in kept], "c string").selectExpr("c", "concat(c, 'x', c, 'y', c) as t")
    got = {r.c for r in df.where(strip("t") != df.t).collect()}
    assert got == {r.c for r in df.where(df.c.rlike(f"[{SPACE}]")).collect()}
    assert all(re.match(r"\s", c) for c in got)
