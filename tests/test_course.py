"""The mini course, from resolution to detectors; expectations were worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import detect, evaluate
from lectern.operators.concept_graph import build_edges, build_nodes
from lectern.operators.graph import importance
from lectern.sources import sinks
from tests import fixture_course as fx


@pytest.fixture(scope="module")
def course(spark):
    found = fx.resolved(spark)
    nodes = build_nodes(found.concepts, fx.units(spark)).cache()
    edges = build_edges(found.prerequisites, nodes).cache()
    return found, nodes, edges


def names(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


def test_clusters_and_counts(course):
    found, nodes, edges = course
    order = [r.canonical_name for r in found.concepts.orderBy("place").collect()]
    assert order == ["Alpha", "Beta", "Delta", "Gamma", "класичний моноліт", "модульний моноліт", "моноліт"]
    s = found.stats.first()
    assert (s.lectures, s.raw_concept_occurrences, s.unique_concepts, s.concepts_introduced_at_least_once) == (3, 11, 7, 5)
    assert (s.concepts_never_introduced, s.raw_prerequisites, s.kept_prerequisites, s.dropped_prerequisites) == (2, 7, 5, 2)
    assert nodes.count() == 7 and edges.count() == 4
    last = edges.where("src = 'Beta' and dst = 'Alpha'").first()
    assert (last.evidence_lecture, last.evidence_unit) == ("03-c", "03#02")
    beta = found.concepts.where("canonical_name = 'Beta'").first()
    assert beta.aliases == ["BT"] and beta.roles == {"introduced": 2, "used": 1} and beta.lecture_introduced == "02-b"


def test_endpoint_precedence(spark):
    found = fx.resolved(spark, edges=[("02-b", "моноліт", "Alpha", "02#01"), ("03-c", "моноліт", "Alpha", "03#01"), ("01-a", "моноліт", "Alpha", "01#01")])
    got = names(found.prerequisites, "evidence_lecture", "from")
    assert got == [("01-a", "моноліт"), ("02-b", "класичний моноліт"), ("03-c", "моноліт")]


def test_detectors(spark, course):
    _, nodes, edges = course
    early = detect.used_before_introduction(nodes).collect()
    assert [(r.concept, r.n_used_before, r.used_unit, r.introduced_unit) for r in early] == [("Beta", 1, "01#02", "02#01")]
    assert names(detect.orphan_concepts(nodes), "concept") == ["Gamma", "моноліт"]
    conflicts = detect.definition_conflicts(nodes).collect()
    assert [(r.concept, r.definition_count, r.lecture_count) for r in conflicts] == [("Beta", 2, 2)]
    direct = detect.prerequisite_order(nodes, edges, transitive=False)
    assert names(direct, "prerequisite", "dependent") == [("Beta", "Alpha"), ("Delta", "Alpha")]
    every = detect.prerequisite_order(nodes, edges)
    assert names(every, "prerequisite", "dependent", "transitive") == [("Beta", "Alpha", False), ("Delta", "Alpha", False), ("Delta", "Beta", True)]
    assert detect.prerequisite_order_anchored(nodes, edges, fx.manifest(spark)).count() == 0
    assert names(detect.cycles(edges), "cycle") == [["Alpha", "Beta"], ["Alpha", "Beta", "Delta"]]
    cards = detect.forward_ref_cards(nodes, fx.units(spark)).collect()
    assert [(r.id, r.concept, r.use_unit, r.use_text) for r in cards] == [("fwd-0000", "Delta", "02#03", "see [Delta](delta.md)")]


def test_anchored_without_last_duplicate(spark):
    found = fx.resolved(spark, edges=fx.EDGES[:-1])
    nodes = build_nodes(found.concepts, fx.units(spark))
    late = detect.prerequisite_order_anchored(nodes, build_edges(found.prerequisites, nodes), fx.manifest(spark))
    assert names(late, "prerequisite", "dependent", "same_lecture") == [("Beta", "Alpha", False)]
    summary = evaluate.anchored_summary(late).first()
    assert (summary.violations, summary.within_lecture, summary.same_unit) == (1, 0, 0)


def test_importance(spark, course):
    _, nodes, edges = course
    ranks = {r.node: round(r.importance, 4) for r in importance(edges.select("src", "dst"), nodes.select("name")).collect()}
    assert ranks["Alpha"] == 1.0 and ranks["Beta"] == 0.9758 and ranks["Delta"] == 0.5405
    assert {ranks[n] for n in ("Gamma", "моноліт", "класичний моноліт", "модульний моноліт")} == {0.1258}


def test_report_counts_and_order(spark, course):
    _, nodes, edges = course
    report = detect.run_detectors(nodes, edges)
    c = report["counts"].first()
    assert (c.used_before_introduction, c.prerequisite_order, c.prereq_direct, c.prereq_transitive, c.definition_conflicts, c.orphan_concepts, c.cycles) == (1, 3, 2, 1, 1, 2, 2)
    ranked = detect.with_importance(report["prerequisite_order"], detect.graph_importance(nodes, edges), "dependent").collect()
    assert [r.dependent for r in ranked] == ["Alpha", "Alpha", "Beta"]


def test_overrides(spark):
    found = fx.resolved(spark, exclude=["Gamma"])
    assert found.concepts.count() == 6
    assert names(detect.orphan_concepts(build_nodes(found.concepts)), "concept") == ["моноліт"]
    found = fx.resolved(spark, merge=[["моноліт", "модульний моноліт"]])
    assert found.concepts.count() == 6
    assert names(detect.orphan_concepts(build_nodes(found.concepts)), "concept") == ["Gamma"]


def test_split_group_blocks_direct_bridge(spark):
    occ = [("01-a", "Repository", ["сховище"], "introduced", "01#01", "d"), ("02-b", "сховище", [], "used", "02#01", "")]
    base = fx.extractions(spark, [], occ, "clean")
    from lectern.operators.resolve import resolve

    assert resolve(base, fx.manifest(spark), fx.overrides(spark)).concepts.count() == 1
    apart = resolve(base, fx.manifest(spark), fx.overrides(spark, split=[["Repository", "сховище"]])).concepts
    assert apart.count() == 2
    assert apart.where("canonical_name = 'Repository'").first().aliases == []


def test_verified_conflicts(spark, course):
    _, nodes, _ = course
    candidates = detect.definition_conflicts(nodes)
    rows = [("clean", "Beta", 0, [1.0, 0.0]), ("clean", "Beta", 1, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "spec string, concept string, i int, vector array<double>")
    assert [r.semantic_similarity for r in detect.verified_conflicts(candidates, vectors).collect()] == [0.7071]
    assert detect.verified_conflicts(candidates, vectors, threshold=0.7).count() == 0


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_least_similar_by_cones(spark, spread):
    r = random.Random(7)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [("small", k, k % 2, [1.0, float(k), 0.0, 0.0, 0.0, 0.0]) for k in range(5)] + [("alone", k, 1, [1.0] * 6) for k in range(40)]
    for k in range(300):
        rows.append(("large", k, None if k == 7 else r.choice([1, 1, 1, 2, 3]), [0.0] * 6 if k in (20, 21) else [m + r.gauss(0, spread) for m in r.choice(middles)]))
    rows += [("tight", k, k % 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0 + k * spread / 100]) for k in range(120)]
    df = spark.createDataFrame(rows, "concept string, i int, lecture int, vector array<double>")
    want = {}
    for name in ("small", "large", "tight"):
        own = [(i, l, v) for c, i, l, v in rows if c == name and l is not None]
        sims = []
        for a, (_, la, x) in enumerate(own):
            for _, lb, y in own[a + 1 :]:
                if la != lb:
                    size = math.sqrt(sum(u * u for u in x)) * math.sqrt(sum(u * u for u in y))
                    sims.append(sum(u * v for u, v in zip(x, y)) / size if size else 0.0)
        want[name] = (len(sims), min(sims))
    for part in (16, 1000):
        found = {r.concept: (r.n_pairs, r.min_sim) for r in detect.least_similar(df, "concept", "i", "lecture", "vector", part).collect()}
        assert found.keys() == want.keys()
        for name, (n, least) in want.items():
            assert found[name][0] == n and found[name][1] == pytest.approx(least, abs=1e-12)
    assert detect.least_similar(df.where("false"), "concept", "i", "lecture", "vector").count() == 0


def test_old_and_anchored_rules(spark, course):
    _, nodes, _ = course
    rows = [("clean", l, f, t, u) for l, f, t, u in fx.EDGES]
    edges = spark.createDataFrame(rows, "spec string, lecture string, from_raw string, to_raw string, evidence_unit string")
    got = names(detect.compare_rules(nodes, edges, fx.manifest(spark)), "prerequisite", "dependent", "old", "new")
    assert got == [("Alpha", "Beta", False, False), ("Beta", "Alpha", True, False), ("Beta", "Alpha", True, True), ("Beta", "Delta", False, False), ("Delta", "Alpha", True, False)]


def test_writers(spark, course, tmp_path):
    _, nodes, edges = course
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == 7
    whole = sinks.node_link(nodes, edges)
    whole.coalesce(1).write.json(str(tmp_path / "link"))
    from lectern.sources.course import read_graph

    n, e = read_graph(spark, str(tmp_path / "link"))
    assert n.count() == 7 and e.count() == 4
    assert n.where("name = 'Beta'").first().order_introduced == (2, 1)
    assert names(detect.orphan_concepts(n.withColumn("spec", F.lit("x"))), "concept") == ["Gamma", "моноліт"]
    sinks.write_graphml(nodes, edges, str(tmp_path / "xml"))
    import xml.etree.ElementTree as T

    text = "".join(p.read_text() for p in sorted((tmp_path / "xml").glob("part-*")))
    assert len(T.fromstring(text.encode()).findall(".//{*}node")) == 7
    lines = [r.value for r in sinks.vocabulary_text(nodes).collect()]
    assert lines[:2] == ["- Alpha", "- Beta (BT)"]
    sinks.write_report({"orphan_concepts": detect.orphan_concepts(nodes)}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "orphan_concepts")).count() == 2
    sinks.write_overrides(fx.overrides(spark, exclude=["x"]), str(tmp_path / "o"))
    from lectern.sources.course import read_overrides

    assert read_overrides(spark, str(tmp_path / "o")).first().exclude == ["x"]
