"""The graph queries, against plain versions on a small table."""

import random
from datetime import datetime, timedelta

import pytest

from lectern.operators import graph
from lectern.plans import catalog
from tests.test_graph import closure, components, cycles, pairs, rank

FIRST = datetime(1995, 1, 1)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r, folder = random.Random(5), str(tmp_path_factory.mktemp("whole"))
    rows = [(o, n, r.randrange(9) + 9 * (o % 2), float(r.randrange(2, 40)), "N", "O", FIRST + timedelta(days=r.randrange(900))) for o in range(9) for n in range(1, 5)]
    rows += [(0, 2, 3, 7.0, "N", "O", FIRST)]
    kinds = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/lineitem.parquet")
    return folder, rows


def test_graph_queries(spark, table):
    folder, rows = table

    def got(name):
        return [tuple(x) for x in catalog.QUERIES[name](spark, folder).collect()]

    stated = [(a[2], b[2], a[0], a[1], a[6]) for a in rows for b in rows if a[0] == b[0] and b[1] == a[1] + 1 and a[2] != b[2]]
    last = {}
    for s in sorted(stated, key=lambda s: (s[2], s[3], s[4])):
        last[s[:2]] = s[2:]
    edges, known, at = sorted(last), closure(list(last)), {}
    for x in rows:
        at[x[2]] = min(at.get(x[2], x[6]), x[6])
    assert set(got("transitive_closure")) == known and len(edges) > 12
    assert sorted(got("prereq_order_direct")) == [e for e in edges if at[e[0]] > at[e[1]]]
    assert set(got("prereq_order_transitive")) == {(a, b, (a, b) not in last) for a, b in known if a != b and at[a] > at[b]}
    assert sorted(got("edge_last_wins")) == [(*e, *last[e][:2]) for e in edges]
    assert dict(got("connected_components")) == components(edges)
    assert {x[0] for x in got("nodes_on_cycles")} == {a for a, b in known if a == b}
    assert {x[0] for x in got("short_cycles")} == {">".join(map(str, p)) for p in cycles(edges, 3)}
    nodes = sorted({x for e in edges for x in e})
    assert got("graph_counts") == [(len(nodes), len(edges), len(stated))]
    want = rank(edges, nodes)
    want = {k: round(v / max(want.values()), 4) for k, v in want.items()}
    assert dict(got("pagerank")) == pytest.approx(want, abs=1.01e-4)


@pytest.mark.parametrize("seed", [1, 4])
def test_closure_by_way_of_busy_nodes(spark, seed):
    edges = pairs(seed, 12, 16)
    df = spark.createDataFrame(edges, "src int, dst int")
    found = [tuple(x) for x in graph.transitive_closure(df, dense=0).collect()]
    assert set(found) == closure(edges) and len(found) == len(set(found))
