"""Segmentation of markdown lectures into ordered units, rendering, and sentence injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, content_chars, heading_kind, python_lines, strip, unit_id, without_rules

#: Heading of what stands before the first section, and rendered marks (fixed values).
PREAMBLE, LECTURE_WORD, UNIT_WORD = "(преамбула)", "Лекція", "Unit"
FENCE = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]*(```|~~~)"
#: Headings in converted slides (fixed values).
NUMBERED = r"^[0-9]+\.[0-9]+(?:\.[0-9]+)?\.?\s+[А-ЯІЇЄҐA-Z]"
KEYWORD = (
    r"(?iu)^(Визначення|Означення|Теорема|Властивост|Приклад|Наслідок|Лема|Аксіом|Твердження|Алгоритм|Спосіб|Способи|"
    r"Основні визначення|Основні поняття)(?![\p{L}\p{N}_])"
)
FIGURE, PAGE_NUMBER = r"^\s*Рис\.\s*[0-9]", r"^\s*[0-9]{1,3}\s*\z"


#: What a line is: a fence, the two levels of headings that count, other text, or blank.
_FENCE, _ONE, _TWO, _TEXT, _BLANK = range(5)


def _line_kind(line: Column) -> Column:
    found = F.when(line.rlike(FENCE), _FENCE).when(line.startswith("##") & line.rlike(r"^##[\s\p{Z}]+") & ~line.startswith("###"), _TWO)
    return found.when(line.startswith("#") & ~line.startswith("##") & line.rlike(r"^#[\s\p{Z}]+"), _ONE).when(line.rlike(rf"[^{SPACE}]"), _TEXT).otherwise(_BLANK)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once: plain projections may be merged into each use."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _outlined(rows: DataFrame) -> DataFrame:
    """rows with _title and _begun, the places of the title and of the preamble's first line in
    _lines (-1: none), _heads, those of the sections' headings, and _ends, where they end.

    What is outside fences are slices of the lines, so a line is looked at as often whatever the
    number of sections: a fold that adds to a list would copy it at every heading.
    """
    rows = _once(rows, _marked=F.transform("_lines", lambda x, i: F.struct(i.alias("i"), _line_kind(x).alias("kind"))))
    fences = F.transform(F.filter("_marked", lambda x: x["kind"] == _FENCE), lambda x: x["i"])
    rows = _once(rows, _fences=F.concat(F.array(F.lit(-1)), fences, F.array(F.size("_lines"))))
    # Every other stretch between fences is outside them.
    stretch = F.transform("_fences", lambda at, j: F.when((j % 2 == 0) & (j + 1 < F.size("_fences")), F.slice("_marked", at + 2, F.get("_fences", j + 1) - at - 1)))
    rows = _once(rows, _outside=F.flatten(F.array_compact(stretch)))
    ones, twos = F.filter("_outside", lambda x: x["kind"] == _ONE), F.filter("_outside", lambda x: x["kind"] == _TWO)
    rows = _once(rows, _title=F.coalesce(F.get(ones, F.lit(0))["i"], F.lit(-1)), _heads=F.transform(twos, lambda x: x["i"]))
    before = F.slice("_marked", F.lit(1), F.coalesce(F.get("_heads", F.lit(0)), F.size("_lines")))
    body = F.filter(before, lambda x: ~x["kind"].isin(_FENCE, _BLANK) & (x["i"] != F.col("_title")))
    rows = _once(rows, _begun=F.coalesce(F.get(body, F.lit(0))["i"], F.lit(-1)), _ends=F.concat("_heads", F.array(F.size("_lines"))))
    return rows.drop("_marked", "_fences", "_outside")


def segment(lectures: DataFrame) -> DataFrame:
    """lecture_id, lecture_order, title, source_file, units of markdown lectures.

    lectures: lecture_id, lecture_order, file_name, text; a row a lecture. A lecture is taken
    apart where it stands, and its units are slices of its lines: nothing is shuffled. The
    title is the first H1 outside fences, sections are the H2 outside them. Text before the
    first section is a unit of its own, from its first line that is neither blank nor a fence.
    A lecture without a title is titled by its id; one without text has no units.
    """
    rows = _once(lectures.select("lecture_id", "lecture_order", "file_name", "text"), _lines=python_lines(F.col("text")))
    rows = _outlined(rows)
    lines, title, ends = F.col("_lines"), F.col("_title"), F.col("_ends")
    parts = F.transform("_heads", lambda h, j: F.struct(h.alias("head"), (h + 1).alias("at"), F.get(ends, j + 1).alias("end")))
    before = F.array(F.struct(F.lit(-1).alias("head"), F.col("_begun").alias("at"), F.get(ends, F.lit(0)).alias("end")))
    rows = _once(rows, _parts=F.when(F.col("_begun") >= 0, F.concat(before, parts)).otherwise(parts))

    def unit(p: Column, j: Column) -> Column:
        own = F.slice(lines, p["at"] + 1, p["end"] - p["at"])
        untitled = F.concat(F.slice(lines, p["at"] + 1, title - p["at"]), F.slice(lines, title + 2, p["end"] - title - 1))
        body = F.when((title >= p["at"]) & (title < p["end"]), untitled).otherwise(own)
        named = strip(F.regexp_replace(F.get(lines, p["head"]), r"^##[\s\p{Z}]+", ""))
        order = (j + 1).cast("int")
        return F.struct(
            F.when(p["head"] < 0, PREAMBLE).otherwise(named).alias("heading"), F.when(p["head"] < 0, "content").otherwise(heading_kind(named)).alias("kind"),
            without_rules(F.array_join(body, "\n")).alias("text"), unit_id(F.col("lecture_order"), order).alias("unit_id"), order.alias("order"),
        )

    said = F.when(title >= 0, strip(F.regexp_replace(F.get(lines, title), r"^#[\s\p{Z}]+", ""))).otherwise("")
    rows = _once(rows, title=F.coalesce(F.nullif(said, F.lit("")), "lecture_id"), units=F.transform("_parts", unit))
    return rows.select("lecture_id", "lecture_order", "title", F.col("file_name").alias("source_file"), "units")


def manifest(lectures: DataFrame) -> DataFrame:
    """One row of counts a segmented lecture, by lecture_order and then file name."""
    own = F.filter("units", lambda u: u["kind"] == "content")
    chars = content_chars(F.col("units"))
    return lectures.orderBy("lecture_order", "source_file").select(
        "lecture_id", "lecture_order", "title", F.size("units").alias("n_units"), F.size(own).alias("n_content_units"), chars.alias("content_chars")
    )


def render(lectures: DataFrame) -> DataFrame:
    """lecture_id, lecture_order, text: canonical markdown of the content units."""
    own = F.filter("units", lambda u: u["kind"] == "content")
    blocks = F.transform(own, lambda u: F.concat(F.lit(f"## {UNIT_WORD} "), u["unit_id"], F.lit(" — "), u["heading"], F.lit("\n\n"), u["text"], F.lit("\n")))
    head = F.concat(F.lit(f"# {LECTURE_WORD} "), F.col("lecture_order").cast("string"), F.lit(": "), "title", F.lit("\n_Source: "), "source_file", F.lit("_\n"))
    # Whoever reads the text several times shouldn't render it as often.
    return _once(lectures, text=F.array_join(F.concat(F.array(head), blocks), "\n")).select("lecture_id", "lecture_order", "text")


def middle_unit(lectures: DataFrame) -> DataFrame:
    """lecture_id, unit_id: the content unit at half their number, counted from 0."""
    own = F.filter("units", lambda u: u["kind"] == "content")
    return lectures.where(F.size(own) > 0).select("lecture_id", F.get(own, F.floor(F.size(own) / 2).cast("int"))["unit_id"].alias("unit_id"))


def inject(rendered: DataFrame, targets: DataFrame) -> DataFrame:
    """spec, lecture_id, text: rendered lectures with a sentence after the end of a unit.

    rendered: lecture_id, text; targets: spec, lecture_id, unit_id, sentence. Blank lines at
    the unit's end go before the sentence. A unit that isn't there is an error.
    """
    both = targets.join(rendered.select("lecture_id", "text"), "lecture_id")
    header = rf"## {UNIT_WORD} "
    mark = F.concat(F.lit(header), "unit_id", F.lit(" —"))
    padded = F.concat(F.lit("\n"), "text")
    start = F.instr(padded, F.concat(F.lit("\n"), mark))
    after = F.substring(padded, start + 1, F.length(padded))
    next_ = F.regexp_instr(F.substring(after, F.lit(2), F.length(after)), F.lit(rf"\n## {UNIT_WORD} \S+ —"))
    block = F.when(next_ > 0, F.substring(after, F.lit(1), next_)).otherwise(after)
    rest = F.when(next_ > 0, F.substring(after, next_ + 1, F.length(after))).otherwise(F.lit(""))
    bare = F.regexp_replace(block, r"(\n[\s\x{1c}-\x{1f}\x{85}\p{Z}]*)+\z", "")
    made = F.concat(F.substring(padded, F.lit(2), start - 1), bare, F.lit("\n\n"), "sentence", F.lit("\n"), rest)
    missing = F.raise_error(F.concat(F.lit("unit not found: "), "unit_id")).cast("string")
    return both.select("spec", "lecture_id", F.when(start > 0, made).otherwise(missing).alias("text"))


def slides_to_markdown(slides: DataFrame) -> DataFrame:
    """stem, text: extracted slide text as markdown with H2 sections.

    slides: stem, title (the whole heading of the lecture), text. Words broken over line ends
    are joined, blank lines and page numbers dropped, lines that look like headings become
    sections, and other lines of a section one paragraph. Nothing is shuffled.
    """
    joined = F.regexp_replace("text", r"([а-яіїєґА-ЯІЇЄҐ])-\s*\n\s*([а-яіїєґ])", "$1$2")
    lines = F.transform(F.split(joined, "\n"), lambda s: strip(F.regexp_replace(s, "[ \t]+", " ")))
    lines = F.filter(lines, lambda s: (s != "") & ~s.rlike(PAGE_NUMBER))
    short = F.substring(strip(F.element_at(F.split("title", r"\."), -1)), 1, 15)
    body = F.when((F.size(lines) > 0) & F.contains(F.get(lines, F.lit(0)), short), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)

    def heading(s):
        return (F.length(s) <= 90) & ~s.rlike(FIGURE) & (s.rlike(NUMBERED) | s.rlike(KEYWORD))

    rows = _once(slides.select("stem", "title", "text"), body=body)
    own = F.col("body")
    heads = F.filter(F.transform(own, lambda x, i: F.when(heading(x), i).otherwise(-1)), lambda i: i >= 0)
    rows = _once(rows, heads=heads).withColumn("ends", F.concat("heads", F.array(F.size("body"))))

    def block(head: Column, at: Column, end: Column) -> Column:
        para = F.when(end > at, F.concat(F.array_join(F.slice(own, at + 1, end - at), " "), F.lit("\n")))
        return F.array_join(F.array_compact(F.array(F.when(head >= 0, F.concat(F.lit("## "), F.get(own, head), F.lit("\n"))), para)), "\n")

    first = F.array(block(F.lit(-1), F.lit(0), F.get("ends", F.lit(0))))
    blocks = F.concat(first, F.transform("heads", lambda h, j: block(h, h + 1, F.get("ends", j + 1))))
    top = F.array(F.concat(F.lit("# "), "title", F.lit("\n")))
    return rows.select("stem", F.array_join(F.concat(top, F.filter(blocks, lambda b: b != "")), "\n").alias("text"))
