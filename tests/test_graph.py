"""Graph operators against plain versions on random small graphs."""

import random

import pytest

from lectern.operators import cycles as on_cycles
from lectern.operators import graph, paths


def pairs(seed, n=9, m=14):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def closure(edges):
    known = set(edges)
    while True:
        more = {(a, d) for a, b in known for c, d in edges if b == c} - known
        if not more:
            return known
        known |= more


def components(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def cycles(edges, most):
    nxt, out = {}, set()
    for a, b in edges:
        nxt.setdefault(a, []).append(b)

    def go(path):
        for b in nxt.get(path[-1], []):
            if b == path[0]:
                out.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < most:
                go([*path, b])

    for a in nxt:
        go([a])
    return out


def rank(edges, nodes, steps=100, tol=1e-6):
    n, out = len(nodes), {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    x = dict.fromkeys(nodes, 1 / n)
    for _ in range(steps):
        loose = sum(v for k, v in x.items() if k not in out)
        y = {k: 0.15 / n + 0.85 * loose / n for k in nodes}
        for a, bs in out.items():
            for b in bs:
                y[b] += 0.85 * x[a] / len(bs)
        if sum(abs(y[k] - x[k]) for k in nodes) < n * tol:
            return y
        x = y
    return x


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_versions(spark, seed):
    edges = pairs(seed)
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {tuple(r) for r in graph.transitive_closure(df).collect()} == closure(edges)
    own = [(a, b) for a, b in edges if a != b]
    assert {r.node: r.component for r in graph.connected_components(df).collect()} == components(own)
    nodes = sorted({x for e in edges for x in e})
    got = {r.node: r.rank for r in graph.pagerank(df, spark.createDataFrame([(x,) for x in nodes], "node int")).collect()}
    want = rank(edges, nodes)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in nodes)
    known = closure(edges)
    assert {tuple(r) for r in graph.ancestors(df).collect()} == {(a, b, (a, b) not in edges) for a, b in known if a != b}


def test_empty_and_short(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert graph.connected_components(none).count() == 0 and graph.transitive_closure(none).count() == 0
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "src int, dst int")
    assert on_cycles.simple_cycles(ring, 5).count() == 1 and on_cycles.simple_cycles(ring, 4).count() == 0
    alone = spark.createDataFrame([(7,), (8,)], "node int")
    assert {tuple(r) for r in graph.connected_components(none, nodes=alone).collect()} == {(7, 7), (8, 8)}
    assert {r.importance for r in graph.importance(none, alone).collect()} == {1.0}


def test_components_of_a_chain_in_few_rounds(spark, monkeypatch):
    tables = []
    save = graph.Scratch.save
    monkeypatch.setattr(graph.Scratch, "save", lambda self, df: tables.append(1) or save(self, df))
    n = 100_000
    names = list(range(n))
    random.Random(1).shuffle(names)
    for order in (range(1000), names):
        chain = spark.createDataFrame([*zip(order, list(order)[1:], strict=False)], "src int, dst int")
        del tables[:]
        found = graph.connected_components(chain)
        assert found.where("component = 0").count() == found.count() == len(order)
        assert len(tables) <= 20


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_against_plain_versions(spark, seed, monkeypatch):
    edges = pairs(seed, 10, 24)
    df = spark.createDataFrame([*edges, *edges[:3], (1, None), (None, 2)], "src int, dst int")
    want = sorted(cycles(edges, 99))
    assert sorted(tuple(r.path) for r in on_cycles.simple_cycles(df).collect()) == want
    assert sorted(tuple(r.path) for r in on_cycles.simple_cycles(df, 3).collect()) == [p for p in want if len(p) <= 3]
    known = closure(edges)
    part = {a: min(b for b, _ in known if (a, b) in known and (b, a) in known) for a, b in known if a == b}
    assert {r.node for r in on_cycles.nodes_on_cycles(df).collect()} == set(part)
    several = {a: p for a, p in part.items() if list(part.values()).count(p) > 1}
    assert {r.node: r.part for r in on_cycles.strong_parts(df).collect()} == several
    counts = {r.part: (r.n_nodes, r.n_edges, r.n_cycles) for r in on_cycles.cycle_counts(df).collect()}
    inside = [(a, b) for a, b in edges if a != b and a in several and several[a] == several.get(b)]
    assert counts == {
        p: (list(several.values()).count(p), sum(several[a] == p for a, _ in inside), sum(len(c) > 1 and several[c[0]] == p for c in want)) for p in set(several.values())
    }
    if seed == 1:
        monkeypatch.setattr(on_cycles, "IN_TASK", 2)
        assert {r.node: r.part for r in on_cycles.strong_parts(df).collect()} == several
        assert sorted(tuple(r.path) for r in on_cycles.simple_cycles(df).collect()) == want


def test_long_cycles_and_parts(spark, monkeypatch):
    monkeypatch.setattr(on_cycles, "BATCH_NODES", 5)
    ring = [(i, (i + 1) % 10) for i in range(10)]
    other = [(20 + i, 20 + (i + 1) % 4) for i in range(4)]
    df = spark.createDataFrame([*ring, *other, (3, 20), (23, 40), (40, 41)], "src int, dst int")
    assert sorted(r.path for r in on_cycles.simple_cycles(df).collect()) == [list(range(10)), [20, 21, 22, 23]]
    assert {(r.part, r.n_nodes) for r in on_cycles.cycle_counts(df).collect()} == {(0, 10), (20, 4)}
    none = df.where("false")
    assert on_cycles.simple_cycles(none).count() == on_cycles.strong_parts(none).count() == on_cycles.nodes_on_cycles(none).count() == 0


def test_circuits_are_all_of_a_complete_graph():
    from math import factorial

    after = {i: [j for j in range(7) if j != i] for i in range(7)}
    found = [tuple(c) for c in on_cycles.circuits(0, after)]
    assert len(found) == len(set(found)) == sum(factorial(6) // factorial(6 - k) for k in range(1, 7))


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 12, 20), (2, 12, 14), (3, 150, 190), (4, 90, 80)])
def test_late_ancestors(spark, seed, n, m):
    r = random.Random(seed)
    edges = pairs(seed, n, m)
    at = {x: r.randrange(n // 2) for x in range(n) if r.random() < 0.8}
    df = spark.createDataFrame(edges, "src int, dst int")
    times = spark.createDataFrame([*at.items(), (1000, 3), (1001, None)], "node int, at int")
    want = {(a, b, (a, b) not in edges) for a, b in closure(edges) if a != b and a in at and b in at and at[a] > at[b]}
    found = [tuple(x) for x in paths.late_ancestors(df, times, "node", "at").collect()]
    assert set(found) == want and len(found) == len(want) > 0
    assert paths.late_ancestors(df.where("false"), times, "node", "at").count() == 0
