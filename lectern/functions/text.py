"""Name normalisers, unit positions and other column expressions over text.

Classes are spelt out because a bare word class knows only ASCII here, and so are white-space
classes because control separators and no-break spaces count as white space in names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside brackets: letters, digits and underscore; white space of any kind.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Tokens that names are compared without (fixed value).
STOPWORDS = ["the", "a", "an", "of"]
#: Headings of contents and source lists (fixed values).
TOC_HEADINGS = ["зміст", "зміст лекції", "план", "план лекції"]
SOURCE_HEADINGS = ["джерела", "література", "посилання", "додаткові матеріали", "список джерел", "список літератури"]
#: A markdown link to another document (fixed value).
LINK = r"\[([^\]]+)\]\(([^)]+\.md)\)"


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text(c), F.lit(SPACES))


def collapse(c: Column | str) -> Column:
    return strip(F.regexp_replace(text(c), f"[{SPACE}]+", " "))


def plain_name(c: Column | str) -> Column:
    """Lower case, punctuation but ' and - as space, one space between words."""
    return collapse(F.regexp_replace(F.lower(text(c)), f"[^{WORD}{SPACE}'-]+", " "))


def normalize_name(c: Column | str) -> Column:
    """plain_name without the STOPWORDS; null: empty."""
    return F.array_join(F.filter(F.split(plain_name(c), " "), lambda t: (t != "") & ~t.isin(STOPWORDS)), " ")


def spaced_name(c: Column | str) -> Column:
    """Lower case and one space between words; punctuation stays."""
    return collapse(F.lower(strip(c)))


def clean_name(c: Column | str) -> Column:
    """Without one trailing parenthesis."""
    return strip(F.regexp_replace(text(c), rf"[{SPACE}]*\([^)]*\)[{SPACE}]*\z", ""))


def unit_index(unit: Column | str) -> Column:
    """The digits after the first #, else 0."""
    return F.coalesce(F.regexp_extract(text(unit), r"#([0-9]+)", 1).try_cast("int"), F.lit(0))


def position(lecture_order: Column | str, unit: Column | str) -> Column:
    """The logical time of a unit: structs compare field by field."""
    order = F.col(lecture_order) if isinstance(lecture_order, str) else lecture_order
    return F.struct(order.cast("int").alias("lec"), unit_index(unit).alias("unit"))


def unit_id(lecture_order: Column, ordinal: Column) -> Column:
    """At least two digits on both sides of #, more where needed."""
    return F.format_string("%02d#%02d", lecture_order, ordinal)


def lecture_number(stem: Column) -> Column:
    """The first run of digits of a file stem; null without one."""
    return F.regexp_extract(stem, r"([0-9]+)", 1).try_cast("int")


def heading_kind(heading: Column | str) -> Column:
    h = F.regexp_replace(F.lower(strip(heading)), r":+\z", "")
    return F.when(h.isin(TOC_HEADINGS), "toc").when(h.isin(SOURCE_HEADINGS), "sources").otherwise("content")


def without_rules(c: Column) -> Column:
    """Without horizontal rules at either end, also where text is glued to them."""
    inner = F.regexp_replace(strip(c), rf"^(---+[{SPACE}]*\n?)+", "")
    return strip(F.regexp_replace(inner, rf"(\n?---+[{SPACE}]*)+\z", ""))


def stems(term: Column) -> Column:
    """Words of four or more characters; of those over six, all but the last two."""
    found = F.regexp_extract_all(F.lower(text(term)), F.lit(f"[{WORD}'-]+"), F.lit(0))
    long = F.filter(found, lambda w: F.length(w) >= 4)
    return F.transform(long, lambda w: F.when(F.length(w) > 6, F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w))


def is_forward_ref(unit_text: Column, terms: Column) -> Column:
    """Whether a link to another document has a term, or all of a term's stems, in its text."""
    links = F.transform(F.regexp_extract_all(text(unit_text), F.lit(LINK), F.lit(1)), F.lower)
    own = F.filter(terms, lambda t: t.isNotNull() & (t != ""))

    def cites(link: Column, term: Column) -> Column:
        cut = stems(term)
        return F.contains(link, F.lower(term)) | ((F.size(cut) > 0) & F.forall(cut, lambda s: F.contains(link, s)))

    return F.exists(links, lambda link: F.exists(own, lambda t: cites(link, t)))


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: t != ""))


def strict_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))


def either_contains(a: Column, b: Column) -> Column:
    """Equal, or one inside the other; an empty name is inside every name."""
    return F.contains(a, b) | F.contains(b, a)


def names_match(a: Column, b: Column) -> Column:
    return either_contains(normalize_name(a), normalize_name(b))


def spaced_names_match(a: Column, b: Column) -> Column:
    return either_contains(spaced_name(a), spaced_name(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def flat(c: Column, kind: str) -> Column:
    """Any value as a string: null as empty, nested ones as JSON."""
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(c), F.lit(""))
    if kind == "boolean":
        return F.coalesce(F.initcap(c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def excerpt(c: Column, size: int = 500) -> Column:
    return F.substring(text(c), 1, size)


def serial(prefix: str, number: Column, digits: int = 3) -> Column:
    return F.format_string(f"{prefix}%0{digits}d", number.cast("int"))


def tier(k: Column) -> Column:
    """blatant, medium and subtle in turn, from a count that starts at 0."""
    return F.element_at(F.array(*map(F.lit, TIERS)), (k % 3 + 1).cast("int"))


TIERS = ["blatant", "medium", "subtle"]


def number(rows: Column) -> Column:
    """How many an array of rows stands for, each for its `n`."""
    return F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + x["n"])


def role_counts(rows: str) -> Column:
    """Counts of each role in a column of rows with role and n, introduced and used always among them."""
    kinds = F.array_union(F.array(F.lit("introduced"), F.lit("used")), F.array_distinct(F.transform(rows, lambda x: x["role"])))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, number(F.filter(rows, lambda x: x["role"] == k)).cast("int"))))


def content_chars(units: Column) -> Column:
    """Characters of the content units."""
    own = F.filter(units, lambda u: u["kind"] == "content")
    return F.aggregate(own, F.lit(0).cast("long"), lambda s, u: s + F.length(u["text"]))


def cleaned_term(c: Column) -> Column:
    """A vocabulary term without spaces, colons and dashes around it; null if only digits."""
    bare = F.regexp_replace(F.regexp_replace(c, "^[ :—–-]+", ""), r"[ :—–-]+\z", "")
    return F.when((bare != "") & ~bare.rlike(r"^\p{Nd}+\z"), bare)


def vocabulary_line(name: Column, aliases: Column) -> Column:
    more = F.when(F.size(F.coalesce(aliases, F.array())) > 0, F.concat(F.lit(" ("), F.array_join(aliases, ", "), F.lit(")")))
    return F.concat(F.lit("- "), name, F.coalesce(more, F.lit("")))


def quoted(term: Column) -> Column:
    """A pattern that matches a term as it stands."""
    return F.concat(F.lit(r"\Q"), F.regexp_replace(term, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E"))


def python_lines(c: Column) -> Column:
    """The lines of a text at every kind of line end, without an empty last one."""
    parts = F.split(text(c), r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
