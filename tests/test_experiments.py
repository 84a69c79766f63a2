"""Injection generators and evaluators on the mini course, and writers of their files."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import detect, evaluate, inject, keyword
from lectern.operators.concept_graph import build_edges, build_nodes
from lectern.sources import course, sinks
from lectern.streaming import micro_batch
from tests import fixture_course as fx


@pytest.fixture(scope="module")
def graph(spark):
    found = fx.resolved(spark)
    nodes = build_nodes(found.concepts, fx.units(spark)).cache()
    return found, nodes, build_edges(found.prerequisites, nodes).cache()


def texts(spark):
    return spark.createDataFrame([("01-a", 1, "alpha gamma"), ("02-b", 2, "beta"), ("03-c", 3, "delta")], "lecture_id string, lecture_order int, lower string")


def test_concept_injections(spark, graph):
    _, nodes, _ = graph
    plan = inject.Plan([1, 2], 2, ["Sharding", "Bulkhead"])
    flagged = detect.used_before_introduction(nodes)
    got = inject.make_injections(nodes, texts(spark), flagged, plan, 9, 2).orderBy("id").collect()
    # Beta is flagged; Delta and the second monolith are introduced late and unnamed before.
    assert [(r.id, r.type, r.target, r.insert_lecture, r.subtlety) for r in got] == [
        ("inj-001", "used_before_introduction", "Delta", "01-a", "blatant"), ("inj-002", "used_before_introduction", "класичний моноліт", "01-a", "medium"),
        ("inj-003", "orphan_concept", "Sharding", "01-a", "blatant"), ("inj-004", "orphan_concept", "Bulkhead", "02-b", "medium"),
        ("inj-005", "placebo", "Alpha", "03-c", "n/a"), ("inj-006", "placebo", "Beta", "03-c", "n/a"), ("inj-007", "placebo", "Delta", "03-c", "n/a"),
    ]
    assert got[1].sentence == "На цьому етапі зручно застосувати класичний моноліт, щоб коректно розв'язати описану проблему."
    assert got[2].sentence.count("Sharding") == 2 and got[4].expected is None and got[0].expected.concept == "Delta"


def test_prerequisite_injections(spark, graph):
    _, nodes, edges = graph
    flagged = detect.prerequisite_order(nodes, edges)
    plan = inject.Plan([1, 2], 2)
    got = inject.make_prerequisite_injections(nodes, edges, texts(spark), flagged, plan).orderBy("id").collect()
    # Alpha, introduced first, takes the earliest unlinked late concept; one dependent a lecture.
    assert [(r.id, r.type, r.prerequisite, r.dependent, r.insert_lecture) for r in got][:2] == [
        ("po-inj-001", "prerequisite_order", "класичний моноліт", "Alpha", "01-a"), ("po-inj-002", "prerequisite_order", "Delta", "класичний моноліт", "02-b"),
    ]
    assert all(r.subtlety == "n/a" for r in got if r.type == "placebo") and got[0].sentence.startswith("Перш ніж переходити до «Alpha»")


def test_greedy_by_hand(spark):
    rows = [("d1", "p1", "L1", 0, 0), ("d1", "p2", "L1", 0, 1), ("d2", "p1", "L1", 1, 0), ("d2", "p3", "L1", 1, 2), ("d3", "p1", "L2", 2, 0), ("d3", "p2", "L2", 2, 1), ("d4", "p3", "L1", 3, 2)]
    df = spark.createDataFrame(rows, "dependent string, prerequisite string, lecture string, dep_rank int, pre_rank int")
    got = [(r.dependent, r.prerequisite) for r in inject.greedy_pairs(df, 9, 2).orderBy("k").collect()]
    assert got == [("d1", "p1"), ("d3", "p2"), ("d4", "p3")]  # d2 waited for a second lecture
    assert [(r.dependent, r.prerequisite) for r in inject.greedy_pairs(df, 9, 1).orderBy("k").collect()] == [("d1", "p1"), ("d2", "p3"), ("d3", "p2")]


def test_conflict_specs(spark, graph):
    _, nodes, edges = graph
    ranks = detect.graph_importance(nodes, edges)
    manifest = fx.manifest(spark)
    got = inject.conflict_specs(nodes, ranks, manifest, n=2, placebos=1).orderBy("id").collect()
    assert [(r.id, r.kind, r.concept, r.insert_lecture, r.subtlety) for r in got] == [
        ("cnf-inj-001", "conflict", "Alpha", "02-b", "blatant"), ("cnf-inj-002", "conflict", "Delta", "02-b", "medium"), ("cnf-plc-003", "placebo", "модульний моноліт", "03-c", "n/a"),
    ]
    picked = inject.picked_conflicts(nodes, texts(spark), ["Missing", "Alpha"]).collect()
    assert [(r.id, r.concept, r.insert_lecture, r.subtlety) for r in picked] == [("cinj-002", "Alpha", "02-b", "medium")]


def test_batched_scores(spark, graph):
    """Swapping lectures in one plan finds what each variant adds, and nothing for a placebo."""
    found, _, _ = graph
    clean = fx.extractions(spark)
    used = ("02-b", "Delta", [], "used", "02#01", "")
    more = [("02-b", "Orphaned Thing", [], "used", "02#01", ""), used]
    swapped = fx.extractions(spark, occurrences=fx.OCCURRENCES + more).where("lecture_id = '02-b'").withColumn("spec", F.lit("i1"))
    same = clean.where("lecture_id = '03-c'").withColumn("spec", F.lit("i2"))
    every = evaluate.variants(clean, swapped.unionByName(same))
    nodes, edges = evaluate.graphs(every, fx.manifest(spark), fx.units(spark), fx.overrides(spark))
    signatures = evaluate.concept_signatures(nodes)
    new = {(r.spec, r.type, r.concept) for r in evaluate.new_signatures(signatures).collect()}
    assert new == {("i1", "orphan_concept", "Orphaned Thing"), ("i1", "used_before_introduction", "Delta")}
    specs = spark.createDataFrame([("i1", "orphan_concept", "blatant", "the orphaned"), ("i2", "placebo", "n/a", "Alpha")], "spec string, type string, subtlety string, target string")
    scored = {r.spec: r for r in evaluate.score_concepts(specs, signatures).collect()}
    assert (scored["i1"].detected, scored["i1"].matched, scored["i1"].n_new_injected_types, scored["i2"].detected, scored["i2"].n_new_all) == (True, "Orphaned Thing", 2, False, 0)
    results = evaluate.score_concepts(specs, signatures)
    r = evaluate.recall(results).first()
    assert (r.type, r.blatant_hits, r.blatant_n, r.hits, r.n) == ("orphan_concept", 1, 1, 1, 1)
    d = evaluate.drift(results, "n_new_all").first()
    assert (d.placebos, d.new_signatures, d.per_placebo) == (1, 0, 0.0)


def test_minimal_and_anchored_pairs(spark, graph):
    clean = fx.extractions(spark, fx.EDGES[:-1])
    spec = spark.createDataFrame([("p1", "02-b", "Delta", "Beta", "02#01"), ("p2", "03-c", "Alpha", "Delta", "03#02")], "spec string, lecture_id string, prerequisite string, dependent string, insert_unit string")
    every = evaluate.variants(clean, evaluate.with_edge(clean.drop("pos"), spec))
    nodes, edges = evaluate.graphs(every, fx.manifest(spark), fx.units(spark), fx.overrides(spark))
    late = detect.prerequisite_order(nodes, edges)
    kinds = spec.select("spec", F.when(F.col("spec") == "p2", "placebo").otherwise("prerequisite_order").alias("type"), F.lit("subtle").alias("subtlety"), "prerequisite", "dependent")
    scored = {r.spec: r for r in evaluate.score_pairs(kinds, evaluate.pair_signatures(late), late).collect()}
    # The pair was a transitive violation of the clean course already: nothing new, but direct now.
    assert (scored["p1"].detected, scored["p1"].direct_edge, scored["p1"].n_new, scored["p2"].n_new) == (False, True, 0, 0)
    anchored = detect.prerequisite_order_anchored(nodes, edges, fx.manifest(spark))
    scored = {r.spec: r for r in evaluate.score_pairs(kinds, evaluate.pair_signatures(anchored)).collect()}
    assert (scored["p1"].detected, scored["p1"].n_new, scored["p2"].detected, scored["p2"].n_new) == (True, 1, False, 0)
    swapped = evaluate.with_edges(clean, spark.createDataFrame([("01-a", [("A", "B", "", "")])], "lecture_id string, prerequisites array<struct<`from`:string,`to`:string,reason:string,evidence_unit:string>>"))
    assert {r.lecture_id: len(r.prerequisites) for r in swapped.collect()} == {"01-a": 1, "02-b": 0, "03-c": 0}


def test_conflict_tasks(spark, graph):
    found, _, _ = graph
    specs = spark.createDataFrame([("clean", "c1", "conflict", "beta!", "subtle"), ("clean", "c2", "placebo", "моноліт", "n/a"), ("clean", "c3", "conflict", "lph", "blatant"), ("clean", "c4", "conflict", "absent", "blatant")], "spec string, id string, kind string, concept string, subtlety string")
    got = {r.id: (r.is_candidate, r.n_defs) for r in evaluate.conflict_tasks(specs, found.concepts).collect()}
    assert got == {"c1": (True, 2), "c2": (False, 0), "c3": (False, 1), "c4": (False, 0)}


def test_comparisons(spark):
    specs = spark.createDataFrame([("i1", "used_before_introduction", "subtle", "Value Object"), ("i2", "orphan_concept", "medium", "Saga"), ("i3", "placebo", "n/a", "X")], "id string, type string, subtlety string, target string")
    graph = spark.createDataFrame([("i1", True)], "id string, detected boolean")
    words = spark.createDataFrame([("i2", True), ("i1", None)], "id string, kw_detected boolean")
    direct = spark.createDataFrame([("i1", ["the value object here"], None)], "id string, used_before array<string>, orphans array<string>")
    rows = evaluate.compare_methods(specs, graph, words, direct)
    assert {r.id: (r.graph, r.llm_direct, r.keyword) for r in rows.collect()} == {"i1": (True, True, False), "i2": (False, None, True)}
    t = evaluate.tally(rows, ["graph", "llm_direct", "keyword"], ["type"]).where("type = 'orphan_concept'").first()
    assert (t.graph, t.llm_direct, t.keyword, t.n) == (0, 0, 1, 1)
    pairs = spark.createDataFrame([("p1", "prerequisite_order", "subtle", "A b", "C")], "id string, type string, subtlety string, prerequisite string, dependent string")
    said = spark.createDataFrame([("p1", [("c", "a  B")])], "id string, violations array<struct<dependent:string,prerequisite:string>>")
    assert evaluate.compare_pair_methods(pairs, graph, said).first().llm_direct is True


def test_overrides_and_audit(spark):
    old = fx.overrides(spark, merge=[["b", "a"]], exclude=["z"])
    new = spark.createDataFrame([([["a", "b"], ["c", "d"], ["d", "c"]], ["y", "z"])], "merge_groups array<array<string>>, exclude array<string>")
    row = evaluate.merge_overrides(old, new).first()
    assert row.merge_groups == [["b", "a"], ["c", "d"]] and row.exclude == ["y", "z"]
    decisions = spark.createDataFrame([([], ["Gamma"])], "merge_groups array<array<string>>, exclude array<string>")
    _, change = evaluate.audit(fx.extractions(spark, spec="clean"), fx.manifest(spark), None, fx.overrides(spark), decisions)
    assert {tuple(r) for r in change.collect()} == {("Gamma", "removed")}


def test_published_statistics(spark, tmp_path):
    cell = {"use before introduction": 9, "orphan concept": 9}
    counts = {
        "recall": {"injections_per_course_and_type": 9, "temporal_graph": {"x": cell}, "direct_model": {"x": {"use before introduction": 5, "orphan concept": 6}}, "paired": {"both_identified": 11, "temporal_graph_only": 7, "direct_model_only": 0, "both_missed": 0}},
        "precision": {"temporal_graph": {"x": {"flagged": 10, "confirmed": 9}, "y": {"flagged": 30, "confirmed": 15}}, "direct_model": {"x": {"flagged": 4, "confirmed": 2}}},
    }
    (tmp_path / "counts.json").write_text(json.dumps(counts))
    recall, precision, paired = course.read_counts(spark, str(tmp_path / "counts.json"))
    got = {r.method: r for r in evaluate.statistics(recall, precision, paired).collect()}
    g = got["temporal_graph"]
    assert (g.hits, g.trials, g.macro, g.micro) == (18, 18, pytest.approx(0.7), 0.6) and g.mcnemar_p == pytest.approx(2 / 128) and got["direct_model"].hits == 11
    wrong = paired.withColumn("both_identified", F.lit(10))
    with pytest.raises(Exception, match="add up"):
        evaluate.statistics(recall, precision, wrong).collect()


def test_keyword_course(spark, tmp_path):
    clean = spark.createDataFrame([(1, "01-a", "Foo Bar appears."), (2, "02-b", "Foo Bar — це річ.")], "lecture_order int, lecture_id string, text string")
    overlay = spark.createDataFrame([("i1", "02-b", "Foo Bar is a thing. Baz here.")], "spec string, lecture_id string, text string")
    parts = course.with_overlay(clean, overlay)
    found = keyword.detect_terms(parts.withColumnRenamed("lecture_order", "order"), ("spec",))
    specs = spark.createDataFrame([("i1", "orphan_concept", "the baz")], "spec string, type string, target string")
    assert keyword.keyword_hits(specs, found).first().kw_detected is True
    assert sinks.course_text(parts).first().text == "Foo Bar appears.\n\nFoo Bar is a thing. Baz here."
    sinks.write_course(parts, str(tmp_path / "course"))
    units = spark.createDataFrame([(1, "01-a", 0, "01#01", "uses foo bar"), (2, "02-b", 0, "02#01", "Foo Bar")], "lecture_order int, lecture string, i int, unit string, text string")
    first = {r.term: r.first_unit for r in keyword.first_units(found, units).collect()}
    assert first == {"Foo Bar": "01#01", "Baz": None}


def test_readers(spark, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    good = {"lecture_id": "a", "prerequisites": [{"from": "A", "to": "B", "reason": "", "evidence_unit": "u"}]}
    (d / "a.clean.run1.json").write_text(json.dumps(good))
    (d / "a.clean.run2.json").write_text("{broken")
    (d / "s.json").write_text(json.dumps([{"dataset": "d", "id": "1", "sentence": "x"}, {"dataset": "d", "id": "1", "sentence": "y"}]))
    assert [(r.lecture_id, r.run) for r in course.read_runs(spark, str(d / "*.run*.json")).collect()] == [("a", 1)]
    assert course.read_runs(spark, str(d / "none*.json")).count() == 0
    assert course.read_sentences(spark, str(d / "s.json")).first().sentence == "y"
    (d / "e1.json").write_text(json.dumps({"lecture_id": "a", "concepts": [], "prerequisites": []}))
    (d / "e2.json").write_text(json.dumps({"concepts": []}))
    assert course.read_extractions(spark, str(d / "e*.json")).count() == 1
    with pytest.raises(Exception, match="no lecture_id"):
        course.keyed_extractions(spark, str(d / "e*.json")).collect()
    (d / "i1").mkdir()
    (d / "i1" / "llm_direct.json").write_text(json.dumps({"used_before": ["q"], "orphans": []}))
    assert [(r.id, r.used_before) for r in course.read_direct(spark, str(d / "*" / "llm_direct.json"), "used_before array<string>, orphans array<string>").collect()] == [("i1", ["q"])]
    assert course.read_overrides(spark, str(d / "no.json")).first().exclude == []
    pdf = course.read_pdf(spark, str(d / "s.json"), extract=lambda b: f"{len(b)} bytes")
    assert pdf.first().text.endswith("bytes")


def test_injected_files_replace_only_their_own(spark, tmp_path):
    def rows(*specs):
        return spark.createDataFrame([(s, "01-a", f"text of {s}") for s in specs], "spec string, lecture_id string, text string")

    sinks.write_injected(rows("inj-001", "po-inj-001"), str(tmp_path / "i"))
    sinks.write_injected(rows("inj-001"), str(tmp_path / "i"))
    assert sorted(p.name for p in (tmp_path / "i").glob("spec=*")) == ["spec=inj-001", "spec=po-inj-001"]


def test_streaming_times(spark, tmp_path):
    rows = [("x", 5, "introduced"), ("x", 2, "used"), ("y", 1, "introduced"), ("y", 3, "used"), ("z", 1, "used")]
    spark.createDataFrame(rows, "concept string, at int, role string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("concept string, at int, role string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    times = micro_batch.running_times(stream, "concept", F.col("at"), F.col("role") == "introduced", F.col("role") == "used")
    q = times.writeStream.outputMode("complete").format("memory").queryName("times").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.concept for r in micro_batch.violations(spark.table("times")).collect()} == {"x"}
