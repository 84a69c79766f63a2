"""Segmentation, rendering, injection, slides and validation."""

import json

from lectern.operators import quality, segment
from lectern.sources import course, sinks

DEMO = "pre line\n# Title\n## Зміст:\n- a\n## One\ntext\n```\n## not heading\n```\n# Second H1\n---\n## Джерела\nx\n"


def lectures(spark, text=DEMO, name="02-demo"):
    df = spark.createDataFrame([(name, 2, f"{name}.md", text)], "lecture_id string, lecture_order int, file_name string, text string")
    return segment.segment(df)


def test_units(spark):
    r = lectures(spark).first()
    assert (r.title, r.source_file) == ("Title", "02-demo.md")
    assert [(u.unit_id, u.heading, u.kind) for u in r.units] == [("02#01", "(преамбула)", "content"), ("02#02", "Зміст:", "toc"), ("02#03", "One", "content"), ("02#04", "Джерела", "sources")]
    assert r.units[2].text.endswith("# Second H1") and "## not heading" in r.units[2].text and "---" not in r.units[2].text
    m = segment.manifest(lectures(spark)).first()
    assert (m.n_units, m.n_content_units, m.content_chars) == (4, 2, 47)


def test_no_title_no_units(spark):
    r = lectures(spark, "## A\n\n").first()
    assert r.title == "02-demo" and [u.text for u in r.units] == [""]
    assert lectures(spark, "").first().units == []
    late = lectures(spark, "## A\nx\n# Late\ny").first()
    assert late.title == "Late" and late.units[0].text == "x\ny"


def test_render_and_inject(spark):
    lec = lectures(spark)
    text = segment.render(lec).first().text
    assert text.startswith("# Лекція 2: Title\n_Source: 02-demo.md_\n\n## Unit 02#01 — (преамбула)\n\npre line\n\n## Unit 02#03 — One\n\ntext\n")
    assert [r.unit_id for r in segment.middle_unit(lec).collect()] == ["02#03"]
    target = spark.createDataFrame([("s1", "02-demo", "02#01", "New."), ("s2", "02-demo", "02#03", "Last.")], "spec string, lecture_id string, unit_id string, sentence string")
    made = {r.spec: r.text for r in segment.inject(segment.render(lec), target).collect()}
    assert "pre line\n\nNew.\n\n## Unit 02#03" in made["s1"]
    assert made["s2"].endswith("# Second H1\n\nLast.\n")


def test_unknown_unit_raises(spark):
    import pytest

    target = spark.createDataFrame([("s", "02-demo", "02#99", "x")], "spec string, lecture_id string, unit_id string, sentence string")
    with pytest.raises(Exception, match="unit not found"):
        segment.inject(segment.render(lectures(spark)), target).collect()


def test_slides(spark):
    text = "Заголовок теми тут\nТеорема 1. Щось матема-\nтика росте\n12\n\n1.2 Розділ\nРис. 1 графік\nабзац   далі"
    df = spark.createDataFrame([("Тема1.1", "Тема 1.1. Заголовок теми", text)], "stem string, title string, text string")
    got = segment.slides_to_markdown(df).first().text
    assert got == "# Тема 1.1. Заголовок теми\n\n## Теорема 1. Щось математика росте\n\n## 1.2 Розділ\n\nРис. 1 графік абзац далі\n"


def test_files(spark, tmp_path):
    (tmp_path / "02-demo.md").write_text(DEMO, encoding="utf-8")
    (tmp_path / "notes.md").write_text("no number", encoding="utf-8")
    read = course.read_markdown(spark, str(tmp_path))
    assert [(r.lecture_id, r.lecture_order) for r in read.collect()] == [("02-demo", 2)]
    lec = segment.segment(read)
    sinks.write_lectures(lec, str(tmp_path / "units"))
    again = course.read_lectures(spark, str(tmp_path / "units" / "*" / "*.json"))
    assert again.first().units[2].unit_id == "02#03"
    assert course.unit_texts(again).where("unit = '02#01'").first().text == "pre line"
    assert "pre line" in course.lecture_texts(again).first().lower
    sinks.write_rendered(segment.render(lec), str(tmp_path / "rendered"))
    sinks.write_manifest(segment.manifest(lec), str(tmp_path / "manifest"))
    assert course.read_manifest(spark, str(tmp_path / "manifest" / "*.json")).first().n_units == 4


GOOD = {
    "lecture_id": "02-demo", "concepts": [
        {"name": "Text", "aliases": ["line"], "definition": "d", "first_mentioned_unit": "02#03", "role": "introduced"},
        {"name": "Pre", "aliases": [], "definition": "", "first_mentioned_unit": "02#01", "role": "used"},
    ],
    "prerequisites": [{"from": "Text", "to": "Pre", "reason": "r", "evidence_unit": "02#01"}],
}


def mutated(**change):
    x = json.loads(json.dumps(GOOD))
    for path, value in change.items():
        at, keys = x, path.split("__")
        for k in keys[:-1]:
            at = at[int(k) if k.isdigit() else k]
        last = int(keys[-1]) if keys[-1].isdigit() else keys[-1]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return x


def issues(spark, doc):
    raw = spark.createDataFrame([("02-demo", json.dumps(doc, ensure_ascii=False))], "lecture_id string, value string")
    found = quality.validate(raw, lectures(spark))
    return sorted((r.rule, r.severity) for r in found.collect())


def test_validator(spark):
    assert issues(spark, GOOD) == []
    cases = {
        "keys": mutated(extra=1), "lecture": mutated(lecture_id="03-x"), "missing": mutated(concepts__1__role=None), "extra": mutated(concepts__1__more="x"), "empty": mutated(concepts__1__name=" "),
        "role": mutated(concepts__1__role="seen"), "introduced": mutated(concepts__0__definition=" "), "used": mutated(concepts__1__definition="d"), "unit": mutated(concepts__1__first_mentioned_unit="02#02"),
        "own_alias": mutated(concepts__0__aliases=["TEXT"]), "alias": mutated(concepts__0__aliases=["pre"]), "edge_missing": mutated(prerequisites__0__reason=None), "loop": mutated(prerequisites__0__to="text"),
        "from": mutated(prerequisites__0__from="Nowhere"), "edge_unit": mutated(prerequisites__0__evidence_unit="02#02"), "arrays": mutated(prerequisites="x"),
    }
    wanted = {"missing": {"missing", "to"}, "empty": {"empty", "to"}}
    for rule, doc in cases.items():
        assert {r for r, _ in issues(spark, doc)} == wanted.get(rule, {rule}), rule
    twice = mutated()
    twice["prerequisites"].append(twice["prerequisites"][0])
    assert issues(spark, twice) == [("edge", "ERROR")]
    again = mutated()
    again["concepts"].append(dict(again["concepts"][1]))
    assert issues(spark, again) == [("duplicate", "ERROR")]
    absent = mutated(concepts__1__name="Quark", prerequisites__0__to="Quark")
    assert issues(spark, absent) == [("verbatim", "WARNING")]
    raw = spark.createDataFrame([("02-demo", json.dumps(absent))], "lecture_id string, value string")
    v = quality.verdict(quality.validate(raw, lectures(spark)), lectures(spark)).first()
    assert (v.errors, v.warnings, v.valid) == (0, 1, True)
