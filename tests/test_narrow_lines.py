import os

import pytest

from lectern.operators.concept_graph import build_edges
from lectern.plans import trade

DATA = "/root/testdata/sf0.001"


def exchanged(df) -> list[str]:
    """What each exchange of the plan moves: the line under it."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [b for a, b in zip(lines, lines[1:], strict=False) if " Exchange " in a]


def test_lines_move_without_texts(spark, monkeypatch):
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables aren't here")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = trade.by_order(spark, DATA)
        moved = exchanged(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved and not any("p_name" in x or "base" in x for x in moved)
    rows = sorted(map(str, found.collect()))
    for name in ("SENT_PARTS", "SENT_KINDS"):
        monkeypatch.setattr(trade, name, 0)
    assert sorted(map(str, trade.by_order(spark, DATA).collect())) == rows


def test_edges_are_gathered_before_their_ends_are_looked_up(spark):
    edges = spark.createDataFrame([("c", i, "a", "b", f"r{i}", "l", "u") for i in range(5)] + [("c", 9, "a", "x", "r", "l", "u")], "spec string, seq long, from string, to string, reason string, evidence_lecture string, evidence_unit string")
    nodes = spark.createDataFrame([("c", "a"), ("c", "b")], "spec string, name string")
    found = build_edges(edges, nodes)
    assert [(r.src, r.dst, r.reason, r.first_seq) for r in found.collect()] == [("a", "b", "r4", 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Aggregate")
