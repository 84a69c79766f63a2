"""Entity resolution: occurrences of concepts clustered over names and aliases.

Every table carries `spec`, the variant of the course that a row belongs to, so that a clean
course and all its injected variants are resolved in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import normalize_name, position, role_counts, strip, text, tokens
from lectern.operators.graph import BROADCAST_NODES, connected_components
from lectern.operators.order import numbered_within, ranked
from lectern.session import saved


@dataclass
class Resolved:
    """concepts, prerequisites, members (spec, occ_id, cluster) and stats of a resolution."""

    concepts: DataFrame
    prerequisites: DataFrame
    members: DataFrame
    stats: DataFrame


def collect_occurrences(extractions: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences and raw prerequisite edges of extractions, numbered in input order.

    extractions: spec, lecture_id, concepts, prerequisites, pos (the order of lectures). A
    lecture that the manifest lacks has order 0. Concepts without a name are dropped; a null
    role is `used`; empty aliases are dropped.
    """
    order = manifest.select("lecture_id", F.col("lecture_order").alias("lecture_order"))
    rows = extractions.join(order, "lecture_id", "left").withColumn("lecture_order", F.coalesce("lecture_order", F.lit(0)))
    c = rows.select("spec", "pos", F.col("lecture_id").alias("lecture"), "lecture_order", F.posexplode("concepts").alias("i", "c"))
    occs = occurrences(c.select("spec", "pos", "i", "lecture", "lecture_order", "c.*"), "pos", "i")
    e = rows.select("spec", "pos", F.col("lecture_id").alias("evidence_lecture"), F.posexplode("prerequisites").alias("i", "e"))
    return occs, stated(numbered_within(e, ["spec"], "pos", ["i"], "seq").select("spec", "seq", "evidence_lecture", "e.*"))


def occurrences(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Occurrences of a row a stated concept, numbered by (group, order) within each spec.

    rows: spec, lecture, lecture_order, name, aliases, definition, first_mentioned_unit, role,
    the two columns of the order and, where a row stands for several, their number `n`.
    """
    more = [c for c in ("n",) if c in rows.columns]
    occs = rows.select(
        "spec", F.col(group).alias("_group"), F.col(order).alias("_order"), strip("name").alias("name"), F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: text(a) != "").alias("aliases"),
        strip("definition").alias("definition"), strip(F.coalesce(F.nullif("role", F.lit("")), F.lit("used"))).alias("role"), "lecture", "lecture_order", strip("first_mentioned_unit").alias("unit"), *more,
    ).where("name <> ''")
    return numbered_within(occs.withColumn("normalized", normalize_name("name")), ["spec"], "_group", ["_order"], "occ_id").drop("_group", "_order")


def stated(rows: DataFrame) -> DataFrame:
    """Raw prerequisite edges of rows with spec, seq, from, to, reason, evidence_unit,
    evidence_lecture; where a row stands for several, also their number `n` and `last`, the
    order of the last of them, whose reason and unit it has. `told` is passed on."""
    more = [c for c in ("n", "last", "told") if c in rows.columns]
    return rows.select(
        "spec", "seq", strip("from").alias("from_raw"), strip("to").alias("to_raw"), strip("reason").alias("reason"), strip("evidence_unit").alias("evidence_unit"), "evidence_lecture", *more,
    )


def counted(rows: DataFrame) -> DataFrame:
    """rows with their number `n`, 1 where a row stands for itself."""
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("long"))


def gathered(occs: DataFrame) -> DataFrame:
    """Occurrences that say the same at the same place as one row, with their number `n` and the
    least occ_id. Those with a definition stay apart, for each is an item of its concept."""
    defines = (F.col("role") == "introduced") & (F.col("definition") != "")
    rows = counted(occs).withColumns({"_one": F.when(defines, F.col("occ_id")), "definition": F.when(defines, F.col("definition")).otherwise("")})
    same = ["spec", "name", "normalized", "aliases", "definition", "role", "lecture", "lecture_order", "unit", "_one"]
    return rows.groupBy(*same).agg(F.sum("n").alias("n"), F.min("occ_id").alias("occ_id")).drop("_one")


def ambiguous_names(names: DataFrame, keys: DataFrame) -> DataFrame:
    """spec, key: keys whose words are fewer than, and all among, those of two names or more.

    names: spec, normalized (distinct); keys: spec, key. A key of one word or two is judged by
    counts of names alone. A longer one meets the names that hold its two rarest words, where
    the other words are looked up; so a word that all names share brings no pairs about.
    """
    index = names.select("spec", "normalized", tokens(F.col("normalized")).alias("words")).withColumn("n", F.size("words"))
    word = index.select("spec", "normalized", "n", F.explode("words").alias("word"))
    counts = word.groupBy("spec", "word").agg(F.count("*").alias("f"), F.count_if(F.col("n") > 1).alias("longer"))
    asked = keys.select("spec", "key", tokens(F.col("key")).alias("own")).distinct().withColumn("k", F.size("own"))
    # Keys with a word that is in no name drop out here.
    met = asked.select("spec", "key", "k", F.explode("own").alias("word")).join(counts, ["spec", "word"])
    met = met.groupBy("spec", "key", "k").agg(F.array_sort(F.collect_list(F.struct("f", "word", "longer"))).alias("o")).where(F.size("o") == F.col("k"))
    one = met.where((F.col("k") == 1) & (F.col("o")[0]["longer"] >= 2)).select("spec", "key")
    rarest = [F.col("o")[i]["word"] for i in (0, 1)]
    more = met.where("k > 1").select("spec", "key", "k", F.least(*rarest).alias("a"), F.greatest(*rarest).alias("b"))
    # Pairs of words of a name, among words that are one of a key's two.
    chosen = more.select("spec", F.explode(F.array("a", "b")).alias("word")).distinct()
    held = word.join(chosen, ["spec", "word"], "left_semi")
    pairs = held.select("spec", "normalized", "n", F.col("word").alias("a")).join(held.select("spec", "normalized", F.col("word").alias("b")), ["spec", "normalized"]).where("a < b")
    pairs = pairs.join(more.select("spec", "a", "b").distinct(), ["spec", "a", "b"])
    both = pairs.where("n > 2").groupBy("spec", "a", "b").agg(F.count("*").alias("m")).where("m >= 2")
    two = more.where("k = 2").join(both, ["spec", "a", "b"], "left_semi").select("spec", "key")
    met = more.where("k > 2").join(pairs, ["spec", "a", "b"]).where("n > k")
    inside = F.size(F.array_except(tokens(F.col("key")), tokens(F.col("normalized")))) == 0
    many = met.where(inside).groupBy("spec", "key").agg(F.count("*").alias("m")).where("m >= 2").select("spec", "key")
    return one.unionByName(two).unionByName(many)


def _groups(overrides: DataFrame, column: str) -> DataFrame:
    """g, name: the normalised members of override groups."""
    g = overrides.select(F.posexplode(column).alias("g", "names"))
    return g.select("g", F.explode("names").alias("name")).select("g", normalize_name("name").alias("name")).distinct()


def _forbidden(overrides: DataFrame) -> DataFrame:
    """a, b: names that a split group keeps apart (both ways). Override files are small and
    written by hand."""
    g = _groups(overrides, "split_groups")
    other = g.select("g", F.col("name").alias("b"))
    return g.join(other, "g").where("name <> b").select(F.col("name").alias("a"), "b").distinct()


def cluster(occs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Occurrences with their cluster, the least occ_id of it.

    Links: the same non-empty normalised name; an alias that is another occurrence's name,
    unless a split group keeps the two names apart or the alias is ambiguous; and forced
    merges. Excluded names are left out before. Occurrences of a name are together whatever
    happens, so names are linked, not occurrences; one without a name left is by itself.
    """
    alone = F.when(F.col("normalized") == "", F.col("occ_id")).otherwise(-1)
    occs = occs.withColumn("alone", alone)
    key = ["spec", "normalized", "alone"]
    out = overrides.select(F.explode("exclude").alias("x")).select(normalize_name("x").alias("normalized")).distinct()
    names = saved(occs.groupBy(*key).agg(F.min("occ_id").alias("first")).join(out, "normalized", "left_anti"))
    named = names.where("normalized <> ''")
    said = occs.select(*key, F.explode("aliases").alias("alias")).distinct()
    said = said.select(*key, normalize_name("alias").alias("key")).where("key <> '' and key <> normalized").distinct().join(names.select(*key), key, "left_semi")
    bridges = said.join(named.select("spec", F.col("normalized").alias("key")), ["spec", "key"])
    bridges = bridges.join(_forbidden(overrides), (F.col("normalized") == F.col("a")) & (F.col("key") == F.col("b")), "left_anti")
    bridges = saved(bridges.join(ambiguous_names(named.select("spec", "normalized"), bridges.select("spec", "key").distinct()), ["spec", "key"], "left_anti"))
    node = F.struct(*key)
    links = bridges.select(node.alias("a"), F.struct("spec", F.col("key").alias("normalized"), F.lit(-1).cast("long").alias("alone")).alias("b"))
    found = connected_components(links.union(_merged(named, overrides)), "a", "b", names.select(node.alias("node")))
    found = found.select("node.*", "component").join(names, key)
    least = found.groupBy("component").agg(F.min("first").alias("cluster"))
    placed_ = saved(found.join(least, "component").select(*key, "cluster"))
    return occs.join(placed_, key).drop("alone")


def _merged(named: DataFrame, overrides: DataFrame) -> DataFrame:
    """a, b: names that a merge group puts together, each with the group's first."""
    own = named.join(_groups(overrides, "merge_groups").withColumnRenamed("name", "normalized"), "normalized").select("spec", "g", F.struct("spec", "normalized", "alone").alias("a"))
    first = own.groupBy("spec", "g").agg(F.min("a").alias("b"))
    return own.join(first, ["spec", "g"]).select("a", "b")


def canonical_names(members: DataFrame) -> DataFrame:
    """spec, cluster, canonical_name, place: the commonest name of a cluster; at ties one that
    is introduced, then the shortest, then the first. `place` orders clusters by it, in lower
    case; `placed` numbers them."""
    names = counted(members).groupBy("spec", "cluster", "name").agg(F.sum("n").alias("n"), F.max((F.col("role") == "introduced").cast("int")).alias("intro"))
    best = F.row_number().over(Window.partitionBy("spec", "cluster").orderBy(F.desc("n"), F.desc("intro"), F.length("name"), "name"))
    named = names.withColumn("r", best).where("r = 1").select("spec", "cluster", F.col("name").alias("canonical_name"))
    return named.withColumn("place", F.struct(F.lower("canonical_name").alias("name"), "cluster"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of one course with `number`, their place from 1."""
    return ranked(rows, ["place"], "number").withColumn("number", F.col("number") + 1)


def concepts(members: DataFrame, names: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row a cluster: its name, aliases, definitions, introduction, appearances and roles.

    An appearance is a place and a role, with the number `n` of occurrences there; appearances
    stand in the order of their first ones, definitions in that of all. So a row grows with the
    places and definitions of its concept, not with its occurrences.
    """
    own = counted(members)
    defines = (F.col("role") == "introduced") & (F.col("definition") != "")
    rolled = own.groupBy("spec", "cluster").agg(
        F.array_sort(F.collect_list(F.when(defines, F.struct("occ_id", "definition", "lecture", "unit")))).alias("d"), F.array_distinct(F.flatten(F.collect_set(F.concat(F.array("name"), "aliases")))).alias("all"),
    )
    places = own.groupBy("spec", "cluster", "lecture", "lecture_order", "unit", "role").agg(F.min("occ_id").alias("occ_id"), F.sum("n").alias("n"))
    places = places.groupBy("spec", "cluster").agg(F.array_sort(F.collect_list(F.struct("occ_id", "lecture", "lecture_order", "unit", "role", "n", position("lecture_order", "unit").alias("at")))).alias("o"))
    rolled = rolled.join(places, ["spec", "cluster"])
    rows = rolled.join(names, ["spec", "cluster"])
    introduced = F.filter("o", lambda x: x["role"] == "introduced")
    first = F.get(F.array_sort(F.transform(introduced, lambda x: F.struct(x["at"].alias("at"), x["occ_id"].alias("occ_id"), x["lecture"].alias("lecture"), x["unit"].alias("unit")))), F.lit(0))
    rows = rows.withColumn("first", first)
    veto = _forbidden(overrides).groupBy("a").agg(F.collect_set("b").alias("apart"))
    rows = rows.withColumn("cn", normalize_name("canonical_name")).join(F.broadcast(veto), F.col("cn") == F.col("a"), "left")
    none = F.array().cast("array<string>")
    aliases = F.filter(F.array_except("all", F.array("canonical_name")), lambda x: ~F.array_contains(F.coalesce("apart", none), normalize_name(x)))
    return rows.select(
        "spec", "cluster", "place", "canonical_name", F.array_sort(aliases).alias("aliases"),
        F.transform("d", lambda x: F.struct(x["definition"].alias("text"), x["lecture"].alias("lecture"), x["unit"].alias("unit"))).alias("definitions"),
        F.col("first.lecture").alias("lecture_introduced"), F.col("first.unit").alias("unit_introduced"),
        F.transform("o", lambda x: F.struct(x["lecture"].alias("lecture"), x["lecture_order"].alias("lecture_order"), x["unit"].alias("unit"), x["role"].alias("role"), x["n"].alias("n"))).alias("appearances"),
        role_counts("o").alias("roles"),
    )


def resolve_endpoints(raw: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """raw with `from` and `to`: what its ends name in their lecture, or else anywhere.

    Both look-ups keep what was written last: clusters in their place, occurrences in order,
    and of each its name before its aliases. A raw end that names nothing gives null.
    """
    own = members.join(names, ["spec", "cluster"])
    said = own.select("spec", "lecture", "place", "occ_id", "canonical_name", F.posexplode(F.concat(F.array("name"), "aliases")).alias("j", "raw"))
    last = F.struct("place", "occ_id", "j")
    local = saved(said.groupBy("spec", "lecture", "raw").agg(F.max_by("canonical_name", last).alias("here")))
    anywhere = saved(said.groupBy("spec", normalize_name("raw").alias("key")).agg(F.max_by("canonical_name", last).alias("there")))
    # Edges are more than what they name, and stay where they are if that can be sent along.
    near, far = (F.broadcast(df) if df.count() <= BROADCAST_NODES else df for df in (local, anywhere))
    for end in ("from", "to"):
        raw = raw.join(near.select("spec", F.col("lecture").alias("evidence_lecture"), F.col("raw").alias(f"{end}_raw"), "here"), ["spec", "evidence_lecture", f"{end}_raw"], "left")
        # Most ends are named in their lecture; only the others are normalised.
        raw = raw.withColumn("key", F.when(F.col("here").isNull(), normalize_name(f"{end}_raw")))
        raw = raw.join(far, ["spec", "key"], "left").withColumn(end, F.coalesce("here", "there")).drop("key", "here", "there")
    return raw


def resolve(extractions: DataFrame, manifest: DataFrame, overrides: DataFrame) -> Resolved:
    """Clusters, resolved prerequisites (both ends known and apart) and the eight counts."""
    occs, raw = collect_occurrences(extractions, manifest)
    return resolve_stated(occs, raw, extractions.groupBy("spec").agg(F.count("*").alias("lectures")), overrides)


def resolve_stated(occs: DataFrame, raw: DataFrame, lectures: DataFrame, overrides: DataFrame) -> Resolved:
    """`resolve` from occurrences and raw edges; lectures: spec, lectures (their number).

    Occurrences are gathered first; they, members and their names are read several times each,
    so they are kept as tables in the shared folder.
    """
    members = saved(cluster(saved(gathered(occs)), overrides))
    names = saved(canonical_names(members))
    found = concepts(members, names, overrides)
    ends = resolve_endpoints(raw, members, names)
    known = F.col("from").isNotNull() & F.col("to").isNotNull() & (F.col("from") != F.col("to")) & (F.col("from") != "") & (F.col("to") != "")
    kept = ends.where(F.coalesce(known, F.lit(False))).select("spec", "seq", "from", "to", "reason", "evidence_lecture", "evidence_unit", *[c for c in ("n", "last", "told") if c in ends.columns])
    stats = lectures
    for part in (
        members.groupBy("spec").agg(F.sum("n").alias("raw_concept_occurrences")),
        found.groupBy("spec").agg(
            F.count("*").alias("unique_concepts"), F.count_if(F.coalesce("lecture_introduced", F.lit("")) != "").alias("concepts_introduced_at_least_once"),
            F.count_if(F.coalesce("lecture_introduced", F.lit("")) == "").alias("concepts_never_introduced"),
        ),
        counted(raw).groupBy("spec").agg(F.sum("n").alias("raw_prerequisites")),
        counted(kept).groupBy("spec").agg(F.sum("n").alias("kept_prerequisites")),
    ):
        stats = stats.join(part, "spec", "left")
    stats = stats.na.fill(0).withColumn("dropped_prerequisites", F.col("raw_prerequisites") - F.col("kept_prerequisites"))
    return Resolved(found, kept, members, stats)
