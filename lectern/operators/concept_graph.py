"""The temporal concept graph: nodes stamped with a logical time, and prerequisite edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import LINK, position, stems, text
from lectern.session import saved


#: Characters of a piece of a term by which it meets links.
GRAM = 4


def _grams(text_: Column, size: Column) -> Column:
    """All stretches of `size` characters of a text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text_) - size + 1, F.lit(1))), lambda i: F.substring(text_, i, size))


def forward_refs(concepts: DataFrame, units: DataFrame) -> DataFrame:
    """spec, cluster and the place (lecture, unit) of units that have a link to another document
    with one of the concept's terms in its text.

    A link has a term if it holds all of its stems or, where it has none, the term itself. Links
    are taken out of their units once. A term meets only the links that hold the rarest of the
    stretches of GRAM characters in what it must hold, and is then looked for in full. No text
    of a unit moves.
    """
    place = [k for k in ("spec", "lecture", "unit") if k in units.columns]
    links = saved(units.select(*place, F.explode(F.regexp_extract_all(text("text"), F.lit(LINK), F.lit(1))).alias("link")).withColumn("link", F.lower("link")).distinct())
    own = concepts.select("spec", "cluster", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("term")).where("term is not null and term <> ''").distinct()
    cut = stems(F.col("term"))
    # Terms that need the same of a link are one.
    need = F.array_sort(F.array_distinct(F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lower("term")))))
    own = saved(own.select("spec", "cluster", need.alias("need")).distinct())
    grams = F.flatten(F.transform("need", lambda w: _grams(w, F.least(F.length(w), F.lit(GRAM)))))
    asked = own.select("need").distinct().select("need", F.explode(F.array_distinct(grams)).alias("gram"))
    texts = links.select("link").distinct()
    # Pieces of terms shorter than GRAM are as long as the term.
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("link")))).alias("size")
    held = texts.select("link", sizes).select("link", F.explode(F.array_distinct(_grams(F.col("link"), F.col("size")))).alias("gram"))
    held = held.join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count("*").alias("f"))
    # A piece that no link holds makes its term the rarest of all: it meets nothing.
    rarest = asked.join(counts, "gram", "left").groupBy("need").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram"))["gram"].alias("gram"))
    cited = held.join(rarest, "gram").where(F.forall("need", lambda w: F.contains("link", w))).select("need", "link")
    places = links.join(cited, "link").select(*place, "need").distinct()
    return places.join(own, [k for k in ("spec", "need") if k in places.columns]).select("spec", "cluster", "lecture", "unit").distinct()


def appearances(concepts: DataFrame, units: DataFrame | None) -> DataFrame:
    """spec, name, i, lecture, lecture_order, unit, role, n, at, forward_ref: a row an appearance
    (a place and a role), with the number n of occurrences there.

    units: lecture, unit, text (and spec, if texts differ by variant). An appearance is a
    forward reference if its unit names the concept inside a link to another document.
    """
    rows = concepts.select("spec", "cluster", F.col("canonical_name").alias("name"), F.posexplode("appearances").alias("i", "a"))
    rows = rows.select("spec", "cluster", "name", "i", "a.lecture", "a.lecture_order", "a.unit", "a.role", "a.n", position("a.lecture_order", "a.unit").alias("at"))
    if units is None:
        return rows.drop("cluster").withColumn("forward_ref", F.lit(False))
    flags = saved(forward_refs(concepts, units)).withColumn("cited", F.lit(True))
    rows = rows.join(flags, ["spec", "cluster", "lecture", "unit"], "left")
    return rows.select("spec", "name", "i", "lecture", "lecture_order", "unit", "role", "n", "at", F.col("cited").isNotNull().alias("forward_ref"))


def first_where(when: Column, value: Column, order: Column) -> Column:
    """The value of the least order among rows where `when` holds; null without one."""
    return F.min(F.when(when, F.struct(order.alias("o"), value.alias("v"))))["v"]


def build_nodes(concepts: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Graph nodes: when each concept is introduced, first appears and is first used.

    order_first_used is the first appearance of any role that is no forward reference, or of
    any if all are; used_at and used_at_any look at the role `used` alone, without and with
    forward references. Of clusters with the same name the last placed is the node.
    """
    last = F.row_number().over(Window.partitionBy("spec", "canonical_name").orderBy(F.desc("place")))
    own = concepts.withColumn("r", last).where("r = 1").drop("r")
    rows = appearances(own, units)
    place = F.struct("lecture", "unit", "at")
    order = F.struct("at", "i")
    plain, used, intro = ~F.col("forward_ref"), F.col("role") == "used", F.col("role") == "introduced"
    stamps = rows.groupBy("spec", "name").agg(
        first_where(intro, place, order).alias("introduced"), first_where(plain, place, order).alias("seen"), first_where(F.lit(True), place, order).alias("any"),
        first_where(used & plain, place, order).alias("used"), first_where(used, place, order).alias("used_any"),
        F.array_sort(F.collect_list(F.struct("i", "lecture", "lecture_order", "unit", "role", "n", "forward_ref", "at"))).alias("appearances"),
    )
    found = own.drop("appearances", "lecture_introduced", "unit_introduced").withColumnRenamed("canonical_name", "name").join(stamps, ["spec", "name"])
    first = F.coalesce("seen", "any")
    return found.select(
        "spec", "name", "place", "aliases", "definitions", "appearances", "roles", F.coalesce(F.col("roles")["introduced"], F.lit(0)).alias("n_introduced"), F.coalesce(F.col("roles")["used"], F.lit(0)).alias("n_used"),
        F.col("introduced.lecture").alias("lecture_introduced"), F.col("introduced.unit").alias("unit_introduced"), F.col("introduced.at").alias("order_introduced"),
        first["lecture"].alias("lecture_first_used"), first["unit"].alias("unit_first_used"), first["at"].alias("order_first_used"),
        F.col("used.lecture").alias("used_lecture"), F.col("used.unit").alias("used_unit"), F.col("used.at").alias("used_at"),
        F.col("used_any.lecture").alias("used_any_lecture"), F.col("used_any.unit").alias("used_any_unit"), F.col("used_any.at").alias("used_any_at"),
    )


def build_edges(prerequisites: DataFrame, nodes: DataFrame | None = None, last: list[str] | None = None, first: list[str] | None = None) -> DataFrame:
    """spec, src, dst and the attributes of the last of equal edges; ends must be nodes.

    Where a row stands for several stated edges, its `last` is the order of the last of them.
    Columns named in `last` come instead of the attributes, and those in `first`, as first_*, of
    the first of equal edges; if they are numbers, edges are gathered without sorting."""
    order = "last" if "last" in prerequisites.columns else "seq"
    plain = {c: c.split(".")[-1] for c in [*(last or []), *(first or [])]}
    if last is None:
        found = [F.max_by(F.struct("reason", "evidence_lecture", "evidence_unit"), order).alias("e")]
    else:
        found = [F.max_by(c, order).alias(plain[c]) for c in last]
    found += [F.min_by(c, "seq").alias(f"first_{plain[c]}") for c in first or []]
    kept = prerequisites.groupBy("spec", F.col("from").alias("src"), F.col("to").alias("dst")).agg(*found, F.min("seq").alias("first_seq"))
    # Equal edges have equal ends, so ends are looked up once an edge.
    if nodes is not None:
        for end in ("src", "dst"):
            kept = kept.join(nodes.select("spec", F.col("name").alias(end)), ["spec", end], "left_semi")
    own = ["e.reason", "e.evidence_lecture", "e.evidence_unit"] if last is None else [plain[c] for c in last]
    return kept.select("spec", "src", "dst", *own, *[f"first_{plain[c]}" for c in first or []], "first_seq")


def last_edge(edges: DataFrame, src: str, dst: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row a (src, dst): the columns of the row that comes last in the order."""
    rows = edges.groupBy(src, dst).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("e"))
    return rows.select(src, dst, "e.*")
