"""Detectors over the temporal concept graph. Comparisons of times are strict, so what is in
one unit never violates. All tables carry `spec`, the variant of the course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import excerpt, normalize_name, number, position, serial
from lectern.operators.cycles import simple_cycles
from lectern.operators.graph import BROADCAST_NODES, importance
from lectern.operators.paths import late_ancestors
from lectern.session import Scratch, saved

#: Definitions less alike than this conflict (fixed value).
SIMILARITY = 0.82
#: Definitions of a concept that meet in one place.
PART = 512
#: Cones that a large concept's definitions are dealt to, at most. Fewer prune less; nothing is
#: left out.
CONES = 256
#: Added to angles before they decide, for rounding.
ROUNDING = 1e-6


def earliest_before(
    rows: DataFrame, keys: list[str], order: Column, introduced: Column, used: Column,
) -> DataFrame:
    """keys, intro, used_at, n_used_before: what is used before it is introduced.

    rows: one an occurrence, in any order; conditions tell its role. One pass finds both
    times; a second, over the keys that qualify alone, counts the earlier uses.
    """
    marked = rows.select(*keys, order.alias("_at"), introduced.alias("_i"), used.alias("_u"))
    times = marked.groupBy(*keys).agg(F.min(F.when(F.col("_i"), F.col("_at"))).alias("intro"), F.min(F.when(F.col("_u"), F.col("_at"))).alias("used_at"))
    early = times.where("intro is not null and used_at < intro")
    counted = marked.where("_u").join(early, keys).where("_at < intro").groupBy(*keys).agg(F.count("*").alias("n_used_before"))
    return early.join(counted, keys)


def never_introduced(rows: DataFrame, keys: list[str], introduced: Column, used: Column) -> DataFrame:
    """keys, n_used of what is used but never introduced. rows: one an occurrence."""
    counts = rows.groupBy(*keys).agg(F.count_if(introduced).alias("_i"), F.count_if(used).alias("n_used"))
    return counts.where("_i = 0 and n_used > 0").drop("_i")


def used_before_introduction(nodes: DataFrame) -> DataFrame:
    """Concepts used, not in forward references, before they are introduced."""
    early = nodes.where("order_introduced is not null and used_at < order_introduced")
    before = number(F.filter("appearances", lambda a: (a["role"] == "used") & ~a["forward_ref"] & (a["at"] < F.col("order_introduced"))))
    return early.select(
        "spec", F.lit("used_before_introduction").alias("type"), F.col("name").alias("concept"), "used_lecture", "used_unit",
        F.col("lecture_introduced").alias("introduced_lecture"), F.col("unit_introduced").alias("introduced_unit"), before.alias("n_used_before"),
    )


def orphan_concepts(nodes: DataFrame) -> DataFrame:
    """Concepts used, forward references included, but never introduced."""
    return nodes.where("n_introduced = 0 and n_used > 0").select(
        "spec", F.lit("orphan_concept").alias("type"), F.lit("used_without_introduction").alias("subtype"), F.col("name").alias("concept"), "n_used",
        F.col("lecture_first_used").alias("first_used_lecture"), F.col("unit_first_used").alias("first_used_unit"),
    )


def later_than(pairs: DataFrame, times: DataFrame, node: str, at: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Pairs whose src has a later time than dst; pairs without both times are left out."""
    a = times.select(F.col(node).alias(src), F.col(at).alias("src_at"))
    b = times.select(F.col(node).alias(dst), F.col(at).alias("dst_at"))
    return pairs.join(a, src).join(b, dst).where("src_at > dst_at")


def prerequisite_order(nodes: DataFrame, edges: DataFrame, transitive: bool = True) -> DataFrame:
    """Prerequisites introduced after what depends on them, over edges or over all paths."""
    key = F.struct("spec", "name")
    times = nodes.where("order_introduced is not null").select(key.alias("node"), "order_introduced", "lecture_introduced", "unit_introduced")
    arcs = edges.select(F.struct("spec", F.col("src").alias("name")).alias("src"), F.struct("spec", F.col("dst").alias("name")).alias("dst"))
    if transitive:
        late = late_ancestors(arcs, times, "node", "order_introduced").select(F.col("f").alias("src"), F.col("t").alias("dst"), "transitive")
    else:
        late = later_than(arcs.withColumn("transitive", F.lit(False)), times, "node", "order_introduced")
    places = times.select("node", F.struct("lecture_introduced", "unit_introduced").alias("p"))
    late = late.join(places.select(F.col("node").alias("src"), F.col("p").alias("a")), "src").join(places.select(F.col("node").alias("dst"), F.col("p").alias("b")), "dst")
    return late.select(
        F.col("src.spec").alias("spec"), F.lit("prerequisite_order").alias("type"), F.col("src.name").alias("prerequisite"), F.col("dst.name").alias("dependent"), "transitive",
        F.col("a.lecture_introduced").alias("prereq_introduced_lecture"), F.col("a.unit_introduced").alias("prereq_introduced_unit"),
        F.col("b.lecture_introduced").alias("dependent_introduced_lecture"), F.col("b.unit_introduced").alias("dependent_introduced_unit"),
    )


def prerequisite_order_anchored(nodes: DataFrame, edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """Edges whose prerequisite is introduced after the unit that states the dependency.

    Edges stated in a lecture that the manifest lacks are left out; the dependent needs no
    introduction.
    """
    intro = nodes.where("order_introduced is not null").select("spec", F.col("name").alias("src"), "order_introduced")
    order = manifest.select(F.col("lecture_id").alias("evidence_lecture"), F.col("lecture_order").alias("evidence_no"))
    rows = edges.join(intro, ["spec", "src"]).join(order, "evidence_lecture").withColumn("evidence_order", position("evidence_no", "evidence_unit"))
    return rows.where("order_introduced > evidence_order").select(
        "spec", F.lit("prerequisite_order").alias("type"), F.col("src").alias("prerequisite"), F.col("dst").alias("dependent"), F.lit(False).alias("transitive"),
        "evidence_lecture", "evidence_unit", F.col("order_introduced").alias("prereq_introduced_order"), "evidence_order",
        (F.col("order_introduced.lec") == F.col("evidence_order.lec")).alias("same_lecture"),
    )


def definition_conflicts(nodes: DataFrame) -> DataFrame:
    """Concepts with two definitions or more, from two lectures or more."""
    lectures = F.size(F.array_distinct(F.transform("definitions", lambda d: d["lecture"])))
    return nodes.where((F.size("definitions") >= 2) & (lectures >= 2)).select(
        "spec", F.lit("definition_conflict").alias("type"), F.col("name").alias("concept"), F.size("definitions").alias("definition_count"), lectures.alias("lecture_count"), "definitions",
    )


def conflict_candidates(definitions: DataFrame, concept: str, lecture: str) -> DataFrame:
    """concept, n_defs, n_lectures of concepts defined twice or more, in two lectures or more."""
    counted = definitions.groupBy(concept).agg(F.count("*").alias("n_defs"), F.count_distinct(lecture).alias("n_lectures"))
    return counted.where("n_defs >= 2 and n_lectures >= 2")


def _dot(x, y) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _angle(cosine) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def least_similar(definitions: DataFrame, concept: str, position_: str, lecture: str, vector: str, part: int = PART) -> DataFrame:
    """concept, n_pairs, min_sim: the least likeness of definitions from different lectures.

    Positions are distinct within a concept; a definition without a lecture has no pairs.
    Vectors are brought to length 1 once, so a pair costs one product; one of length 0 is at a
    right angle to all. Pairs are counted from the sizes of lectures. Up to `part` definitions
    of a concept meet directly. More are dealt to cones (`_cones`), and a definition only goes
    to the cones that may hold one less like it than the best pair known.
    """
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(length == 0, F.transform(wide, lambda x: F.lit(0.0))).otherwise(F.transform(wide, lambda x: x / length))
    rows = definitions.select(F.col(concept).alias("c"), F.col(position_).alias("i"), F.col(lecture).alias("l"), unit.alias("x")).where("l is not null")
    sizes = rows.groupBy("c", "l").agg(F.count("*").alias("n")).groupBy("c").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    scratch = Scratch(definitions.sparkSession)
    sizes = scratch.save(sizes.select("c", ((F.col("n") * F.col("n") - F.col("own")) / 2).cast("long").alias("n_pairs"), F.ceil(F.col("n") / part).cast("int").alias("parts")).where("n_pairs > 0"))
    small = rows.join(sizes.where("parts = 1").select("c"), "c")
    one = F.array(F.lit(0), F.lit(0))
    ends = small.select("c", "i", "l", "x", one.alias("own"), one.alias("other"))
    found = None
    if not sizes.where("parts > 1").isEmpty():
        dealt, found = _cones(rows.join(sizes.where("parts > 1").select("c", "parts"), "c"), part, scratch)
        ends = ends.unionByName(dealt)
    a = ends.select("c", F.col("own").alias("p"), F.col("other").alias("q"), "i", F.col("l").alias("la"), "x")
    b = ends.select("c", F.col("other").alias("p"), F.col("own").alias("q"), F.col("i").alias("j"), F.col("l").alias("lb"), F.col("x").alias("y"))
    pairs = a.join(b, ["c", "p", "q"]).where("i < j and la <> lb")
    least = pairs.groupBy("c").agg(F.min(_dot("x", "y")).alias("s"))
    least = least if found is None else least.unionByName(found).groupBy("c").agg(F.min("s").alias("s"))
    return sizes.join(least, "c", "left").select(F.col("c").alias(concept), "n_pairs", F.least(F.lit(1.0), F.col("s")).alias("min_sim"))


def _cones(rows: DataFrame, part: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Definitions of large concepts with their own cell and each cell that they must meet,
    and the least likeness known by then (c, s).

    Some definitions, one a part and at most CONES a concept, are centres; every definition
    belongs to the nearest. The angle of two definitions is at most that of the one and a
    centre, and the half-angle of the centre's cone. If even that can't beat the best pair of a
    definition and a centre, the cone is passed by. A cone is cut to cells of about `part`
    rows, so one with most of the rows is spread as well.
    """
    place = F.pmod(F.xxhash64("i"), F.least("parts", F.lit(CONES)))
    centres = rows.groupBy("c", place.alias("k")).agg(F.min_by(F.struct("x", "l"), "i").alias("z")).groupBy("c").agg(F.collect_list("z").alias("centres"))
    near = rows.join(centres, "c").withColumn("dots", F.transform("centres", lambda z: _dot(F.col("x"), z["x"])))
    apart = F.array_min(F.zip_with("dots", "centres", lambda d, z: F.when(z["l"] != F.col("l"), d)))
    near = near.select("c", "i", "l", "x", "dots", (F.array_position("dots", F.array_max("dots")) - 1).cast("int").alias("cone"), apart.alias("apart"))
    near = scratch.save(near.where("cone >= 0"))
    best = near.groupBy("c").agg(F.min("apart").alias("s"))
    cones = near.groupBy("c", "cone").agg(F.max(_angle(F.get("dots", "cone"))).alias("half"), F.ceil(F.count("*") / part).cast("int").alias("cells"))
    known = cones.groupBy("c").agg(F.collect_list(F.struct("cone", "half", "cells")).alias("cones")).join(best, "c")
    rows = near.join(known, "c").withColumn("bar", F.coalesce(_angle(F.col("s")), F.lit(0.0)) - ROUNDING)
    rows = rows.withColumn("own", F.array("cone", F.pmod(F.xxhash64(F.lit(1), "i"), F.element_at(F.filter("cones", lambda z: z["cone"] == F.col("cone")), 1)["cells"]).cast("int")))
    open_ = F.filter("cones", lambda z: _angle(F.get("dots", z["cone"])) + z["half"] >= F.col("bar"))
    cells = F.flatten(F.transform(open_, lambda z: F.transform(F.sequence(F.lit(0), z["cells"] - 1), lambda k: F.array(z["cone"], k))))
    return rows.select("c", "i", "l", "x", "own", F.explode(cells).alias("other")), best


def verified_conflicts(candidates: DataFrame, vectors: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Conflict candidates with a pair of definitions less alike than the threshold.

    vectors: spec, concept, i (the definition's place), vector.
    """
    rows = candidates.select("spec", "concept", F.posexplode("definitions").alias("i", "d")).select("spec", "concept", "i", F.col("d.lecture").alias("lecture"))
    rows = rows.join(vectors, ["spec", "concept", "i"]).withColumn("key", F.struct("spec", "concept"))
    low = least_similar(rows, "key", "i", "lecture", "vector").where(F.col("min_sim") < threshold)
    low = low.select("key.spec", "key.concept", F.round("min_sim", 4).alias("semantic_similarity"))
    return candidates.join(low, ["spec", "concept"]).withColumn("verified", F.lit(True))


def embed(texts: DataFrame, column: str, provider, size: int) -> DataFrame:
    """texts with `vector`, from a provider of vectors for a list of texts, in batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def vectors(values):
        import pandas as pd

        out = []
        for s in range(0, len(values), size):
            out += [list(map(float, v)) for v in provider(list(values[s : s + size]))]
        return pd.Series(out)

    return texts.withColumn("vector", vectors(F.col(column)))


def cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """spec, length, cycle of all dependency cycles; with max_len, of those of up to so many
    concepts."""
    arcs = edges.select(F.struct("spec", F.col("src").alias("name")).alias("src"), F.struct("spec", F.col("dst").alias("name")).alias("dst"))
    names = F.transform("path", lambda p: p["name"])
    found = simple_cycles(arcs, max_len)
    return found.select(F.col("path")[0]["spec"].alias("spec"), F.lit("cyclic_dependency").alias("type"), F.size("path").alias("length"), names.alias("cycle"))


def graph_importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, importance of the nodes of one course."""
    own = edges.select("src", "dst")
    return importance(own, nodes.select("name")).withColumnRenamed("node", "name")


def with_importance(violations: DataFrame, ranks: DataFrame, key: str) -> DataFrame:
    """Violations with the importance of a concept, most important first, then by its name."""
    r = ranks.select(F.col("name").alias("_n"), F.col("importance").alias("_v"))
    rows = violations.join(r, violations[key] == r["_n"], "left").withColumn("importance", F.round(F.coalesce("_v", F.lit(0.0)), 4)).drop("_n", "_v")
    return rows.orderBy(F.desc("importance"), *[c for c in (key, "prerequisite", "dependent") if c in rows.columns])


def run_detectors(nodes: DataFrame, edges: DataFrame, transitive: bool = True, max_cycle: int | None = None) -> dict[str, DataFrame]:
    """One table a kind of violation, and `counts`."""
    order = prerequisite_order(nodes, edges, transitive)
    found = {
        "used_before_introduction": used_before_introduction(nodes), "prerequisite_order": order, "definition_conflicts": definition_conflicts(nodes),
        "orphan_concepts": orphan_concepts(nodes), "cycles": cycles(edges, max_cycle),
    }
    kinds = [df.select("spec", F.lit(k).alias("kind"), (F.col("transitive") if k == "prerequisite_order" else F.lit(False)).alias("transitive")) for k, df in found.items()]
    every = kinds[0]
    for k in kinds[1:]:
        every = every.unionByName(k)
    counts = every.groupBy("spec").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in found],
        F.count_if((F.col("kind") == "prerequisite_order") & ~F.col("transitive")).alias("prereq_direct"), F.count_if(F.col("transitive")).alias("prereq_transitive"),
    )
    specs = nodes.select("spec").distinct()
    return found | {"counts": specs.join(counts, "spec", "left").na.fill(0)}


def forward_ref_cards(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """Cards of concepts whose only uses before their introduction are forward references."""
    rows = nodes.where("order_introduced is not null and used_any_at < order_introduced and (used_at is null or not used_at < order_introduced)")
    before = F.filter("appearances", lambda a: a["forward_ref"] & (a["at"] < F.col("order_introduced")))
    first = F.get(F.array_sort(F.transform(before, lambda a: F.struct(a["at"].alias("at"), a["i"].alias("i"), a["lecture"].alias("lecture"), a["unit"].alias("unit")))), F.lit(0))
    rows = rows.withColumn("use_lecture", F.coalesce(first["lecture"], "used_any_lecture")).withColumn("use_unit", F.coalesce(first["unit"], "used_any_unit"))
    texts = units.select(F.col("lecture").alias("l"), F.col("unit").alias("u"), "text")
    rows = rows.join(texts, (F.col("use_lecture") == F.col("l")) & (F.col("use_unit") == F.col("u")), "left").withColumn("use_text", excerpt("text")).drop("l", "u", "text")
    rows = rows.join(texts, (F.col("lecture_introduced") == F.col("l")) & (F.col("unit_introduced") == F.col("u")), "left").withColumn("intro_text", excerpt("text"))
    number = F.row_number().over(Window.partitionBy("spec").orderBy("place")) - 1
    return rows.select("spec", serial("fwd-", number, 4).alias("id"), F.col("name").alias("concept"), "use_lecture", "use_unit", "use_text", "lecture_introduced", "unit_introduced", "intro_text")


def compare_rules(nodes: DataFrame, edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """spec, prerequisite, dependent, old, new for each stated edge: whether it violates by
    introductions alone and as anchored. Both ends must be introduced.

    edges: spec, lecture, from_raw, to_raw, evidence_unit, and `n` where a row stands for several
    (the result has it then too). Ends are looked up by name first,
    then by the first alias.
    """
    names = nodes.select("spec", "name", "place", normalize_name("name").alias("key"), F.lit(0).alias("kind"), F.lit(0).alias("j"))
    more = nodes.select("spec", "name", "place", F.posexplode("aliases").alias("j", "a")).select("spec", "name", "place", normalize_name("a").alias("key"), F.lit(1).alias("kind"), "j")
    # A name takes a key from whoever had it; an alias only takes a free one: the last name
    # wins, else the first alias.
    latest = F.when(F.col("kind") == 0, F.col("place")).desc()
    rank = F.row_number().over(Window.partitionBy("spec", "key").orderBy("kind", latest, "place", "j"))
    keys = names.unionByName(more).withColumn("r", rank).where("r = 1").select("spec", "key", F.col("name").alias("found"))
    # Names are normalised and looked up once each, with their introduction; edges are more.
    intro = nodes.where("order_introduced is not null").select("spec", F.col("name").alias("found"), "order_introduced")
    raws = edges.select("spec", F.explode(F.array("from_raw", "to_raw")).alias("raw")).distinct().withColumn("key", normalize_name("raw"))
    ends = saved(raws.join(keys, ["spec", "key"]).join(intro, ["spec", "found"]).select("spec", "raw", "found", "order_introduced"))
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_NODES else ends
    rows = edges
    for raw, end, at in (("from_raw", "prerequisite", "ai"), ("to_raw", "dependent", "bi")):
        rows = rows.join(ends.select("spec", F.col("raw").alias(raw), F.col("found").alias(end), F.col("order_introduced").alias(at)), ["spec", raw])
    order = manifest.select(F.col("lecture_id").alias("lecture"), "lecture_order")
    rows = rows.join(order, "lecture", "left").withColumn("ev", position(F.coalesce("lecture_order", F.lit(0)), "evidence_unit"))
    return rows.where("prerequisite <> dependent").select("spec", "prerequisite", "dependent", (F.col("ai") > F.col("bi")).alias("old"), (F.col("ai") > F.col("ev")).alias("new"), *[c for c in ("n",) if c in edges.columns])
