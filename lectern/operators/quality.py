"""Validation of extractions against the units of their lecture, as data-quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import strip
from lectern.session import saved

#: A unit id in extractions (fixed value).
UNIT_ID = r"^[0-9]{2}#[0-9]{2}$"
TOP, CONCEPT, EDGE = (
    ["lecture_id", "concepts", "prerequisites"], ["name", "aliases", "definition", "first_mentioned_unit", "role"], ["from", "to", "reason", "evidence_unit"],
)


def _issue(df: DataFrame, rule: str, when: Column, detail: Column, severity: str = "ERROR", at: str = "i") -> DataFrame:
    where = F.col(at).cast("int") if at in df.columns else F.lit(None).cast("int")
    return df.where(when).select("lecture_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), where.alias("i"), detail.cast("string").alias("detail"))


def _keys(raw: Column) -> Column:
    return F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))


def _is_array(raw: Column) -> Column:
    return F.coalesce(F.json_array_length(raw), F.lit(-1)) >= 0


def validate(raw: DataFrame, lectures: DataFrame) -> DataFrame:
    """lecture_id, rule, severity, i, detail: one row an issue.

    raw: lecture_id (of the units file), value (the extraction as JSON text). lectures: units
    as segmented. Rules: keys, lecture (V1), arrays (V2), missing, extra (V3), empty,
    duplicate (V4), role, introduced, used (V5), unit (V6), own_alias (V7), alias (V8),
    verbatim (V9, a warning) and, of prerequisites, edge_missing, from, to, loop, edge, and
    edge_unit (V10). A concept without all fields or without a name is judged no further.
    """
    units = lectures.select(
        "lecture_id", F.transform(F.filter("units", lambda u: u["kind"] == "content"), lambda u: u["unit_id"]).alias("content"),
        F.lower(F.concat(F.array_join(F.transform("units", lambda u: u["text"]), "\n"), F.lit("\n"), F.array_join(F.transform("units", lambda u: u["heading"]), "\n"))).alias("searchable"),
    )
    top = raw.select("lecture_id", "value", F.get_json_object("value", "$.lecture_id").alias("said"), F.get_json_object("value", "$.concepts").alias("cs"), F.get_json_object("value", "$.prerequisites").alias("ps"))
    # What the rules read is parsed once: extractions, their items, and the items in their units.
    units, top = saved(units), saved(top)
    arrays = (F.col("cs").isNull() | _is_array(F.col("cs"))) & (F.col("ps").isNull() | _is_array(F.col("ps")))
    issues = [
        _issue(top, "keys", F.sort_array(_keys(F.col("value"))) != F.array(*map(F.lit, sorted(TOP))), F.array_join(_keys(F.col("value")), ",")),
        _issue(top, "lecture", ~F.col("said").eqNullSafe(F.col("lecture_id")), F.col("said")),
        _issue(top, "arrays", ~arrays, F.lit("concepts, prerequisites")),
    ]
    good = top.where(arrays)

    def items(column: str) -> DataFrame:
        parsed = F.from_json(F.coalesce(F.col(column), F.lit("[]")), "array<string>")
        return good.select("lecture_id", F.posexplode(parsed).alias("i", "raw"))

    lacks = F.array_except(F.array(*map(F.lit, CONCEPT)), _keys(F.col("raw")))
    more = F.array_except(_keys(F.col("raw")), F.array(*map(F.lit, CONCEPT)))
    field = {c: F.coalesce(F.get_json_object("raw", f"$.{c}"), F.lit("")) for c in CONCEPT}
    concepts = items("cs").select(
        "lecture_id", "i", lacks.alias("lacks"), more.alias("more"), *[v.alias(c) for c, v in field.items() if c != "aliases"], F.get_json_object("raw", "$.aliases").alias("aliases")
    )
    concepts = saved(concepts.withColumn("nl", F.lower(strip("name"))))
    issues.append(_issue(concepts, "missing", F.size("lacks") > 0, F.array_join(F.sort_array("lacks"), ",")))
    whole = concepts.where(F.size("lacks") == 0)
    issues.append(_issue(whole, "extra", F.size("more") > 0, F.array_join(F.sort_array("more"), ",")))
    issues.append(_issue(whole, "empty", F.col("nl") == "", F.lit("empty name")))
    named = whole.where("nl <> ''").withColumn("before", F.lag("i").over(Window.partitionBy("lecture_id", "nl").orderBy("i")))
    defined = strip("definition") != ""
    al = F.when(_is_array(F.col("aliases")), F.transform(F.from_json("aliases", "array<string>"), lambda a: F.lower(strip(a))))
    in_units = F.array_contains(F.coalesce("content", F.array().cast("array<string>")), F.col("first_mentioned_unit"))
    said = F.contains("searchable", F.col("nl")) | F.exists("al", lambda a: F.contains(F.col("searchable"), a))
    named = named.withColumn("al", al).join(units, "lecture_id", "left")
    named = saved(named.select("lecture_id", "i", "name", "nl", "role", "first_mentioned_unit", "before", defined.alias("defined"), "al", in_units.alias("in_units"), said.alias("said")))
    introduced, defined = F.col("role") == "introduced", F.col("defined")
    own = named.where("al is not null")
    issues += [
        _issue(named, "duplicate", F.col("before").isNotNull(), F.format_string("%s, also %d", "name", "before")),
        _issue(named, "role", ~F.col("role").isin("introduced", "used"), F.col("role")),
        _issue(named, "introduced", introduced & ~defined, F.col("name")),
        _issue(named, "used", (F.col("role") == "used") & defined, F.col("name")),
        _issue(named, "unit", ~F.col("in_units"), F.col("first_mentioned_unit")),
        _issue(named, "aliases", F.col("al").isNull(), F.col("name")),
        _issue(own, "own_alias", F.array_contains("al", F.col("nl")), F.col("name")),
        _issue(own, "verbatim", ~F.coalesce("said", F.lit(False)), F.col("name"), "WARNING"),
    ]
    names = named.groupBy("lecture_id", "nl").agg(F.max("i").alias("last"))
    owners = own.select("lecture_id", "i", "name", F.posexplode("al").alias("j", "nl")).groupBy("lecture_id", "nl").agg(F.min_by("i", F.struct("i", "j")).alias("i"))
    issues.append(_issue(owners.join(names, ["lecture_id", "nl"]), "alias", F.col("last") != F.col("i"), F.col("nl")))

    lacks = F.array_except(F.array(*map(F.lit, EDGE)), _keys(F.col("raw")))
    edges = items("ps").select(
        "lecture_id", "i", lacks.alias("lacks"), F.lower(strip(F.get_json_object("raw", "$.from"))).alias("f"), F.lower(strip(F.get_json_object("raw", "$.to"))).alias("t"),
        F.coalesce(F.get_json_object("raw", "$.evidence_unit"), F.lit("")).alias("unit"),
    )
    edges = saved(edges)
    issues.append(_issue(edges, "edge_missing", F.size("lacks") > 0, F.array_join(F.sort_array("lacks"), ",")))
    edges = edges.where(F.size("lacks") == 0)
    for rule, end in (("from", "f"), ("to", "t")):
        unknown = edges.join(names.select("lecture_id", F.col("nl").alias(end)), ["lecture_id", end], "left_anti")
        issues.append(_issue(unknown, rule, F.lit(True), F.col(end)))
    again = edges.withColumn("n", F.row_number().over(Window.partitionBy("lecture_id", "f", "t").orderBy("i")))
    issues += [
        _issue(edges, "loop", F.col("f") == F.col("t"), F.col("f")),
        _issue(again, "edge", F.col("n") > 1, F.concat_ws(" -> ", "f", "t")),
        _issue(edges.join(units, "lecture_id", "left"), "edge_unit", ~F.array_contains(F.coalesce("content", F.array().cast("array<string>")), F.col("unit")), F.col("unit")),
    ]
    return reduce(DataFrame.unionByName, issues)


def schema_issues(raw: DataFrame) -> DataFrame:
    """lecture_id, rule, severity, i, detail of what the extraction's schema forbids besides
    missing and extra fields of concepts (V12): values of a wrong kind (type), empty names and
    ends (short), unit ids that aren't two digits on both sides of # (pattern), further fields
    of prerequisites (additional).

    raw: lecture_id, value (the extraction as JSON text). What isn't an array holds no items.
    """
    found = []
    for column, fields, texts, unit in (("concepts", CONCEPT, ["name"], "first_mentioned_unit"), ("prerequisites", EDGE, ["from", "to"], "evidence_unit")):
        own = F.get_json_object("value", f"$.{column}")
        rows = raw.select("lecture_id", F.posexplode(F.from_json(F.when(_is_array(own), own), "array<string>")).alias("i", "raw"))
        rows = rows.withColumn("v", F.try_parse_json("raw"))
        kinds = {c: F.schema_of_variant(F.try_variant_get("v", f"$.{c}", "variant")) for c in fields}
        wrong = F.array_compact(F.array(*[F.when(~F.coalesce(k.rlike(r"^ARRAY<(STRING|VOID)>$" if c == "aliases" else "^STRING$"), F.lit(True)), F.lit(c)) for c, k in kinds.items()]))
        short = F.array_compact(F.array(*[F.when(F.get_json_object("raw", f"$.{c}") == "", F.lit(c)) for c in texts]))
        found += [
            _issue(rows, f"{column}_type", F.size(wrong) > 0, F.array_join(wrong, ",")),
            _issue(rows, f"{column}_short", F.size(short) > 0, F.array_join(short, ",")),
            _issue(rows, f"{column}_pattern", ~F.get_json_object("raw", f"$.{unit}").rlike(UNIT_ID), F.get_json_object("raw", f"$.{unit}")),
        ]
        if column == "prerequisites":
            more = F.array_except(_keys(F.col("raw")), F.array(*map(F.lit, fields)))
            found.append(_issue(rows, f"{column}_additional", F.size(more) > 0, F.array_join(F.sort_array(more), ",")))
    return reduce(DataFrame.unionByName, found)


def verdict(issues: DataFrame, lectures: DataFrame) -> DataFrame:
    """lecture_id, errors, warnings, valid."""
    counts = issues.groupBy("lecture_id").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    found = lectures.select("lecture_id").join(counts, "lecture_id", "left").na.fill(0, ["errors", "warnings"])
    return found.withColumn("valid", F.col("errors") == 0)


def missing_keys(rows: DataFrame, key: str, against: DataFrame, other: str) -> DataFrame:
    """Rows whose key is nowhere in the other table."""
    return rows.join(against.select(F.col(other).alias(key)).distinct(), key, "left_anti")


def repeated(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows after the first of equal keys, with the place before (before)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("before", F.lag(order[0]).over(by)).withColumn("n", F.row_number().over(by)).where("n > 1").drop("n")
