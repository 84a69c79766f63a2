"""Commands over a course folder."""

import json

import pytest

from lectern.__main__ import main
from lectern.operators import segment
from tests import fixture_course as fx


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("c") / "dataset-9"
    (root / "notes").mkdir(parents=True)
    for name in ("units", "extraction", "dedicated_edges", "injections"):
        (root / name).mkdir()
    for n, (lid, order) in enumerate(fx.MANIFEST):
        (root / "notes" / f"{lid}.md").write_text(f"# L{order}\n## One\nAlpha text {n}\n## Two\nplain\n## Three\nsee [Delta](delta.md)\n", encoding="utf-8")
        concepts = [{"name": c, "aliases": a, "definition": d, "first_mentioned_unit": u, "role": r} for x, c, a, r, u, d in fx.OCCURRENCES if x == lid]
        edges = [{"from": f, "to": t, "reason": "", "evidence_unit": u} for x, f, t, u in fx.EDGES if x == lid]
        (root / "extraction" / f"{lid}.json").write_text(json.dumps({"lecture_id": lid, "concepts": concepts, "prerequisites": edges}, ensure_ascii=False), encoding="utf-8")
        for k in (1, 2, 3):
            (root / "dedicated_edges" / f"{lid}.clean.run{k}.json").write_text(json.dumps({"lecture_id": lid, "prerequisites": edges}, ensure_ascii=False), encoding="utf-8")
    from lectern.sources.course import read_markdown

    lectures = segment.segment(read_markdown(spark, str(root / "notes")))
    for row in lectures.toJSON().collect():
        (root / "units" / f"{json.loads(row)['lecture_id']}.json").write_text(row, encoding="utf-8")
    (root / "manifest.json").write_text(json.dumps([json.loads(r) for r in segment.manifest(lectures).toJSON().collect()]), encoding="utf-8")
    (root / "prereq_specs.json").write_text(json.dumps([{"id": "p1", "type": "prerequisite_order", "prerequisite": "Delta", "dependent": "класичний моноліт", "insert_lecture": "02-b", "subtlety": "subtle", "insert_unit": "02#02"}], ensure_ascii=False), encoding="utf-8")
    return root


def run(spark, folder, *args):
    return main([args[0], "--course", str(folder), *args[1:]], spark)


def rows(spark, folder, name):
    return spark.read.json(str(folder / "results" / name))


def test_detect_and_graph(spark, folder):
    assert run(spark, folder, "detect", "--max-cycle", "3") == 0
    counts = rows(spark, folder, "violations/counts").first()
    assert (counts.used_before_introduction, counts.orphan_concepts, counts.cycles) == (1, 2, 2)
    assert run(spark, folder, "graph") == 0 and rows(spark, folder, "node_link").count() == 1
    assert run(spark, folder, "vocabulary") == 0


def test_votes_and_anchors(spark, folder):
    assert run(spark, folder, "consensus") == 0 and rows(spark, folder, "consensus").where("n_runs = 3").count() == 3
    assert run(spark, folder, "anchored") == 0
    assert run(spark, folder, "score-minimal") == 0
    assert rows(spark, folder, "score-minimal").first().detected is True


def test_validate_and_segment(spark, folder):
    assert run(spark, folder, "validate") == 1  # the course names units that its notes lack
    assert run(spark, folder, "segment", "--src", str(folder / "notes")) == 0
    assert run(spark, folder, "keyword") == 0
    with pytest.raises(SystemExit):
        run(spark, folder, "nonsense")
