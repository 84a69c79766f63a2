"""Queries of the whole chain over the trade course: resolution, graph, detectors, injections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import detect, inject, resolve
from lectern.operators.order import ranked
from lectern.plans import trade
from lectern.plans.registry import query
from lectern.plans.trade import CONCEPTS_SQL, EDGES_SQL, LINES_SQL, MEMBERS_SQL, NODES_SQL
from lectern.sources import sinks

#: Places in results: the month's number and the unit's, of a struct of lec and unit.
GRAPH_SQL = CONCEPTS_SQL + NODES_SQL
BOTH_SQL = GRAPH_SQL + EDGES_SQL.removeprefix(MEMBERS_SQL)


def _lec(at: str) -> Column:
    return F.col(f"{at}.lec")


@query(f"WITH RECURSIVE {MEMBERS_SQL} SELECT occ_id, name, lo AS lecture_order, role, definition, canonical AS canonical_name, cluster, place FROM members JOIN canon USING (cluster)")
def trade_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a part with the concept it belongs to."""
    occs, _ = resolve.collect_occurrences(trade.extractions(spark, sf_dir), trade.manifest(spark, sf_dir))
    members = resolve.cluster(occs, trade.overrides(spark, sf_dir))
    names = resolve.placed(resolve.canonical_names(members))
    return members.join(names, ["spec", "cluster"]).select("occ_id", "name", "lecture_order", "role", "definition", "canonical_name", "cluster", F.col("number").alias("place"))


@query(f"""WITH RECURSIVE {CONCEPTS_SQL} SELECT place, canonical AS canonical_name, aliases, n_defs, n_def_lectures, first_def, intro[1] AS lecture_introduced, intro[2] AS unit_introduced, n_seen, n_introduced, n_used FROM with_aliases""")
def trade_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a concept: aliases, definitions, introduction, appearances and roles."""
    found = resolve.placed(trade.resolved(spark, sf_dir).concepts)
    lectures = F.size(F.array_distinct(F.transform("definitions", lambda d: d["lecture"])))
    return found.select(
        F.col("number").alias("place"), "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.size("definitions").cast("long").alias("n_defs"), lectures.cast("long").alias("n_def_lectures"),
        F.get("definitions", F.lit(0))["text"].alias("first_def"), "lecture_introduced", "unit_introduced", text.number(F.col("appearances")).alias("n_seen"),
        F.col("roles")["introduced"].cast("long").alias("n_introduced"), F.col("roles")["used"].cast("long").alias("n_used"),
    )


@query(f"WITH RECURSIVE {EDGES_SQL} SELECT seq, src, dst, reason, lecture AS evidence_lecture, evidence_unit FROM good")
def trade_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated prerequisites whose ends name two concepts, in their order."""
    course = trade.Course(spark, sf_dir)
    course.stated = trade.each_stated(course.orders)
    found = course.resolved.prerequisites
    return found.select("seq", F.col("from").alias("src"), F.col("to").alias("dst"), "reason", "evidence_lecture", "evidence_unit")


@query(f"""WITH RECURSIVE {EDGES_SQL}, c AS (SELECT cluster, count(*) FILTER (role = 'introduced') AS n FROM members GROUP BY 1)
SELECT (SELECT count(DISTINCT lec) FROM li) AS lectures, (SELECT count(*) FROM members) AS raw_concept_occurrences, (SELECT count(*) FROM c) AS unique_concepts, (SELECT count(*) FROM c WHERE n > 0) AS concepts_introduced_at_least_once,
  (SELECT count(*) FROM c WHERE n = 0) AS concepts_never_introduced, (SELECT count(*) FROM stated) AS raw_prerequisites, (SELECT count(*) FROM good) AS kept_prerequisites, (SELECT count(*) FROM stated) - (SELECT count(*) FROM good) AS dropped_prerequisites""")
def trade_resolution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade.resolved(spark, sf_dir).stats.drop("spec")


@query(f"""WITH RECURSIVE {GRAPH_SQL} SELECT canonical AS name, intro[1] AS lecture_introduced, intro[2] AS unit_introduced, intro[3] AS intro_order, intro[4] AS intro_unit, first_used[1] AS lecture_first_used, first_used[2] AS unit_first_used,
  used[1] AS used_lecture, used[2] AS used_unit, used_any[1] AS used_any_lecture, used_any[2] AS used_any_unit, n_introduced, n_used FROM nodes""")
def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each concept is introduced, first seen and first used, with and without forward references."""
    nodes, _ = trade.graph(spark, sf_dir)
    return nodes.select(
        "name", "lecture_introduced", "unit_introduced", _lec("order_introduced").alias("intro_order"), F.col("order_introduced.unit").alias("intro_unit"), "lecture_first_used", "unit_first_used",
        "used_lecture", "used_unit", "used_any_lecture", "used_any_unit", F.col("n_introduced").cast("long").alias("n_introduced"), F.col("n_used").cast("long").alias("n_used"),
    )


@query(f"WITH RECURSIVE {EDGES_SQL} SELECT src, dst, reason, evidence_lecture, evidence_unit, first_seq FROM edges")
def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between concepts, with what was stated last."""
    return trade.graph(spark, sf_dir)[1].drop("spec")


@query(f"""WITH RECURSIVE {GRAPH_SQL} SELECT n.canonical AS concept, used[1] AS used_lecture, used[2] AS used_unit, intro[1] AS introduced_lecture, intro[2] AS introduced_unit, count(*) AS n_used_before
FROM nodes n JOIN seen s ON s.place = n.place AND s.role = 'used' AND NOT s.fwd AND (s.lo, s.un) < (intro[3], intro[4]) WHERE intro IS NOT NULL AND (used[3], used[4]) < (intro[3], intro[4]) GROUP BY ALL""")
def trade_used_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.used_before_introduction(trade.graph(spark, sf_dir)[0])
    return found.select("concept", "used_lecture", "used_unit", "introduced_lecture", "introduced_unit", F.col("n_used_before").cast("long").alias("n_used_before"))


@query(f"WITH RECURSIVE {GRAPH_SQL} SELECT canonical AS concept, n_used, first_used[1] AS first_used_lecture, first_used[2] AS first_used_unit, 'used_without_introduction' AS subtype FROM nodes WHERE n_introduced = 0 AND n_used > 0")
def trade_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.orphan_concepts(trade.graph(spark, sf_dir)[0])
    return found.select("concept", F.col("n_used").cast("long").alias("n_used"), "first_used_lecture", "first_used_unit", "subtype")


@query(f"WITH RECURSIVE {CONCEPTS_SQL} SELECT canonical AS concept, n_defs AS definition_count, n_def_lectures AS lecture_count FROM concepts WHERE n_defs >= 2 AND n_def_lectures >= 2")
def trade_definition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.definition_conflicts(trade.graph(spark, sf_dir)[0])
    return found.select("concept", F.col("definition_count").cast("long").alias("definition_count"), F.col("lecture_count").cast("long").alias("lecture_count"))


@query(f"""WITH RECURSIVE {GRAPH_SQL},
w AS (SELECT n.place, arg_min((s.lecture, s.unit), (s.lo, s.un, s.occ_id)) FILTER (s.fwd AND (s.lo, s.un) < (intro[3], intro[4])) AS u FROM nodes n JOIN seen s ON s.place = n.place
  WHERE intro IS NOT NULL AND (used_any[3], used_any[4]) < (intro[3], intro[4]) AND (used IS NULL OR NOT (used[3], used[4]) < (intro[3], intro[4])) GROUP BY 1),
r AS (SELECT n.*, row_number() OVER (ORDER BY place) - 1 AS k, coalesce(u[1], used_any[1]) AS ul, coalesce(u[2], used_any[2]) AS uu FROM nodes n JOIN w USING (place))
SELECT printf('fwd-%04d', k) AS id, canonical AS concept, ul AS use_lecture, uu AS use_unit, left(coalesce(a.text, ''), 500) AS use_text, intro[1] AS lecture_introduced, intro[2] AS unit_introduced, left(coalesce(b.text, ''), 500) AS intro_text
FROM r LEFT JOIN unit_text a ON a.lecture = ul AND a.unit = uu LEFT JOIN unit_text b ON b.lecture = intro[1] AND b.unit = intro[2]""")
def trade_forward_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts whose only uses before their introduction are forward references."""
    course = trade.Course(spark, sf_dir)
    return detect.forward_ref_cards(course.nodes, course.units).drop("spec")


_ANCHORED = """anchored AS (SELECT e.*, n.intro[3] AS il, n.intro[4] AS iu, m.lec AS el, CASE WHEN evidence_unit = '' THEN 0 ELSE regexp_extract(evidence_unit, '#([0-9]+)', 1)::INT END AS eu
  FROM edges e JOIN nodes n ON n.canonical = e.src JOIN man m ON m.lecture = e.evidence_lecture WHERE n.intro IS NOT NULL)"""


@query(f"WITH RECURSIVE {BOTH_SQL}, {_ANCHORED} SELECT src AS prerequisite, dst AS dependent, evidence_lecture, evidence_unit, il AS prereq_order, el AS evidence_order, il = el AS same_lecture FROM anchored WHERE (il, iu) > (el, eu)")
def trade_order_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites introduced after the unit that states them."""
    course = trade.Course(spark, sf_dir)
    found = detect.prerequisite_order_anchored(course.nodes, course.edges, course.manifest)
    return found.select("prerequisite", "dependent", "evidence_lecture", "evidence_unit", _lec("prereq_introduced_order").alias("prereq_order"), _lec("evidence_order").alias("evidence_order"), "same_lecture")


@query(f"""WITH RECURSIVE {BOTH_SQL}, {_ANCHORED} SELECT count(*) AS violations, count(*) AS direct, count(*) FILTER (il = el) AS within_lecture, 0::BIGINT AS same_unit FROM anchored WHERE (il, iu) > (el, eu) HAVING count(*) > 0""")
def trade_anchored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.evaluate import anchored_summary

    course = trade.Course(spark, sf_dir)
    return anchored_summary(detect.prerequisite_order_anchored(course.nodes, course.edges, course.manifest)).drop("spec")


@query(f"""WITH RECURSIVE {BOTH_SQL} SELECT e.src AS prerequisite, e.dst AS dependent, a.intro[1] AS prereq_introduced_lecture, a.intro[2] AS prereq_introduced_unit, b.intro[1] AS dependent_introduced_lecture, b.intro[2] AS dependent_introduced_unit
FROM edges e JOIN nodes a ON a.canonical = e.src JOIN nodes b ON b.canonical = e.dst WHERE a.intro IS NOT NULL AND b.intro IS NOT NULL AND (a.intro[3], a.intro[4]) > (b.intro[3], b.intro[4])""")
def trade_order_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites introduced after what directly depends on them."""
    nodes, edges = trade.graph(spark, sf_dir)
    return detect.prerequisite_order(nodes, edges, transitive=False).drop("spec", "type", "transitive")


@query(f"""WITH RECURSIVE {BOTH_SQL}, t AS (SELECT place, canonical, {trade.norm_sql('term')} AS key, row_number() OVER (PARTITION BY place ORDER BY term) AS j FROM terms),
keys AS (SELECT key, arg_min(canonical, (kind, p, j)) AS found FROM (
  SELECT canonical, {trade.norm_sql('canonical')} AS key, 0 AS kind, -place AS p, 0 AS j FROM concepts UNION ALL SELECT canonical, key, 1, place, j FROM t) GROUP BY 1),
r AS (SELECT p.found AS prerequisite, d.found AS dependent, s.lecture, s.evidence_unit FROM stated s JOIN keys p ON p.key = {trade.norm_sql('from_raw')} JOIN keys d ON d.key = {trade.norm_sql('to_raw')} WHERE p.found <> d.found),
v AS (SELECT r.*, a.intro AS ai, b.intro AS bi, coalesce(m.lec, 0) AS el, CASE WHEN evidence_unit = '' THEN 0 ELSE regexp_extract(evidence_unit, '#([0-9]+)', 1)::INT END AS eu
  FROM r JOIN nodes a ON a.canonical = prerequisite JOIN nodes b ON b.canonical = dependent LEFT JOIN man m ON m.lecture = r.lecture WHERE a.intro IS NOT NULL AND b.intro IS NOT NULL)
SELECT prerequisite, dependent, count(*) AS n, count(*) FILTER ((ai[3], ai[4]) > (bi[3], bi[4])) AS old_rule, count(*) FILTER ((ai[3], ai[4]) > (el, eu)) AS new_rule FROM v GROUP BY 1, 2""")
def trade_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each stated pair violates by introductions alone, and as anchored."""
    course = trade.Course(spark, sf_dir)
    found = detect.compare_rules(course.nodes, course.raw.withColumnRenamed("evidence_lecture", "lecture"), course.manifest)
    hits = [F.coalesce(F.sum(F.when(F.col(k), F.col("n"))), F.lit(0)).alias(f"{k}_rule") for k in ("old", "new")]
    return found.groupBy("prerequisite", "dependent").agg(F.sum("n").alias("n"), *hits)


_RANKS_SQL = """ranks AS (SELECT canonical AS name, n_seen::DOUBLE / max(n_seen) OVER () AS importance FROM concepts)"""


def _ranks(nodes: DataFrame) -> DataFrame:
    """Appearances as importance; only the orders that use it are at stake here."""
    seen = text.number(F.col("appearances"))
    most = nodes.agg(F.max(seen).alias("most"))
    return nodes.join(F.broadcast(most)).select("name", (seen.cast("double") / F.col("most")).alias("importance"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_RANKS_SQL}, o AS (SELECT canonical AS concept, round(importance, 4) AS importance FROM nodes JOIN ranks ON name = canonical WHERE n_introduced = 0 AND n_used > 0)
SELECT concept, importance, row_number() OVER (ORDER BY importance DESC, concept) AS rank FROM o""")
def trade_ranked_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans by importance and then by name, numbered in that order."""
    nodes, _ = trade.graph(spark, sf_dir)
    found = detect.with_importance(detect.orphan_concepts(nodes), _ranks(nodes), "concept").select("concept", "importance")
    return ranked(found, [F.desc("importance"), "concept"], "rank").withColumn("rank", F.col("rank") + 1)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_RANKS_SQL}, ids AS (SELECT list((lec, lecture) ORDER BY lec, lecture) AS ids FROM man),
one AS (SELECT n.*, importance, intro[1] AS lecture_introduced, list_filter(ids, lambda x: x[2] <> intro[1]) AS others FROM nodes n JOIN ranks ON name = canonical, ids WHERE n_defs = 1 AND intro IS NOT NULL),
w AS (SELECT o.*, coalesce((SELECT arg_min(lecture, (lo, lecture)) FROM seen s WHERE s.place = o.place AND s.lecture <> lecture_introduced), others[len(others) // 2 + 1][2]) AS insert_lecture FROM one o),
k AS (SELECT *, row_number() OVER (ORDER BY importance DESC, canonical DESC, first_def DESC, lecture_introduced DESC, insert_lecture DESC) - 1 AS k FROM w WHERE insert_lecture IS NOT NULL)
SELECT CASE WHEN k < 9 THEN printf('cnf-inj-%03d', k + 1) ELSE printf('cnf-plc-%03d', k + 1) END AS id, CASE WHEN k < 9 THEN 'conflict' ELSE 'placebo' END AS kind, canonical AS concept, first_def AS original_definition,
  lecture_introduced AS original_lecture, insert_lecture, CASE WHEN k < 9 THEN ['blatant', 'medium', 'subtle'][(k % 3 + 1)::INT] ELSE 'n/a' END AS subtlety FROM k WHERE k < 12""")
def trade_conflict_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine most important concepts of one definition as targets, the next three as placebos."""
    course = trade.Course(spark, sf_dir)
    return inject.conflict_specs(course.nodes, _ranks(course.nodes), course.manifest)


#: The course's texts: units in their order, in lower case.
_LECTURES_SQL = "lectures AS (SELECT m.lec, m.lecture, coalesce((SELECT string_agg(lower(text), ' ' ORDER BY unit) FROM unit_text u WHERE u.lecture = m.lecture), '') AS low FROM man m)"
_EARLY = [10, 20, 30]
_ORPHANS = ["Blue-green deployment", "Canary release", "Saga"]


def lectures(course: trade.Course) -> DataFrame:
    parts = course.units.withColumnRenamed("lecture", "lecture_id")
    whole = sinks.course_text(parts, ("lecture_id",), "unit", "unit", "text", " ")
    return course.manifest.join(whole, "lecture_id", "left").select("lecture_id", "lecture_order", F.lower(F.coalesce("text", F.lit(""))).alias("lower"))


def _case(templates: dict[str, str], *names: str) -> str:
    """SQL that fills the templates of each tier."""
    out = "CASE subtlety"
    for level, t in templates.items():
        filled = "'" + t.replace("'", "''") + "'"
        for i, n in enumerate(names, 1):
            filled = f"replace(replace({filled}, '%{i}$s', {n}), '%s', {n})"
        out += f" WHEN '{level}' THEN {filled}"
    return out + " END"


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_LECTURES_SQL},
flagged AS (SELECT {trade.plain_sql('canonical')} AS k FROM nodes WHERE intro IS NOT NULL AND used IS NOT NULL AND (used[3], used[4]) < (intro[3], intro[4])),
late AS (SELECT canonical, intro[3] AS il, {trade.plain_sql('canonical')} AS key FROM nodes WHERE intro[3] >= 40 AND n_defs > 0 AND {trade.plain_sql('canonical')} NOT IN (SELECT k FROM flagged)),
ubi AS (SELECT canonical AS target, arg_min(lecture, lec) AS insert_lecture FROM late JOIN lectures ON lec IN ({', '.join(map(str, _EARLY))}) AND lec < il AND NOT contains(low, key) GROUP BY 1 ORDER BY 1 LIMIT 9),
n AS (SELECT count(*) AS n FROM man),
orph AS (SELECT unnest([{', '.join(f"'{x}'" for x in _ORPHANS)}]) AS target, unnest(range({len(_ORPHANS)})) AS k),
plc AS (SELECT canonical AS target, intro[3] AS il FROM nodes WHERE n_introduced > 0 AND n_used > 0 ORDER BY 1 LIMIT 3),
later AS (SELECT target, coalesce((SELECT list(lecture ORDER BY lec) FROM man WHERE lec > il), []) AS l FROM plc),
specs AS (
  SELECT 0 AS part, row_number() OVER (ORDER BY target) - 1 AS k, 'used_before_introduction' AS type, target, insert_lecture FROM ubi UNION ALL
  SELECT 1, k, 'orphan_concept', target, (SELECT list(lecture ORDER BY lec)[(k % max(n) + 1)::INT] FROM man, n) FROM orph UNION ALL
  SELECT 2, row_number() OVER (ORDER BY target) - 1, 'placebo', target, CASE WHEN len(l) > 0 THEN l[len(l) // 2 + 1] ELSE (SELECT max(lecture) FROM man) END FROM later),
tiers AS (SELECT *, CASE WHEN type = 'placebo' THEN 'n/a' ELSE ['blatant', 'medium', 'subtle'][(k % 3 + 1)::INT] END AS subtlety, row_number() OVER (ORDER BY part, k) AS idx FROM specs)
SELECT printf('inj-%03d', idx) AS id, type, target, insert_lecture, subtlety, CASE WHEN part = 0 THEN {_case(inject.USED_BEFORE, 'target')} WHEN part = 1 THEN {_case(inject.ORPHAN, 'target')} ELSE replace('{inject.RECAP}', '%s', target) END AS sentence,
  CASE WHEN part < 2 THEN type END AS expected_type FROM tiers""")
def trade_injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs of injections: late concepts used early, unknown terms, and placebos."""
    course = trade.Course(spark, sf_dir)
    nodes = course.nodes
    plan = inject.Plan(_EARLY, 40, _ORPHANS)
    flagged = detect.used_before_introduction(nodes).select("concept")
    made = inject.make_injections(nodes, lectures(course), flagged, plan)
    return made.select("id", "type", "target", "insert_lecture", "subtlety", "sentence", F.col("expected.type").alias("expected_type"))


@query(f"""WITH RECURSIVE {BOTH_SQL}, {_LECTURES_SQL},
d AS (SELECT canonical, intro[1] AS lecture, intro[3] AS lec FROM nodes WHERE n_defs > 0 AND intro IS NOT NULL),
deps AS (SELECT *, row_number() OVER (ORDER BY canonical) - 1 AS dep_rank FROM d WHERE lec IN ({', '.join(map(str, _EARLY))})),
pres AS (SELECT *, row_number() OVER (ORDER BY lec, canonical) - 1 AS pre_rank FROM d WHERE lec >= 70)
SELECT a.canonical AS dependent, p.canonical AS prerequisite, a.lecture, dep_rank, pre_rank FROM deps a JOIN pres p ON p.lec > a.lec AND p.canonical <> a.canonical
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = p.canonical AND e.dst = a.canonical OR e.src = a.canonical AND e.dst = p.canonical)
  AND NOT contains(coalesce((SELECT low FROM lectures l WHERE l.lecture = a.lecture), ''), {trade.plain_sql('p.canonical')})""")
def trade_prerequisite_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that may be injected as a prerequisite met too late."""
    course = trade.Course(spark, sf_dir)
    flagged = spark.createDataFrame([], "prerequisite string, dependent string")
    found = inject.prerequisite_candidates(course.nodes, course.edges, lectures(course), flagged, inject.Plan(_EARLY, 70))
    return found.select("dependent", "prerequisite", "lecture", F.col("dep_rank").cast("long").alias("dep_rank"), F.col("pre_rank").cast("long").alias("pre_rank"))


#: The first pair after the last one chosen whose ends are free; while fewer lectures are used than
#: there are early ones, it must be of a new one.
_CHOICE = f"""SELECT c.dependent, c.prerequisite, c.lecture, c.dep_rank, c.pre_rank FROM cand c WHERE (c.dep_rank, c.pre_rank) > (g.dep_rank, g.pre_rank)
  AND NOT list_contains(g.deps, c.dependent) AND NOT list_contains(g.pres, c.prerequisite) AND NOT (list_contains(g.lecs, c.lecture) AND len(list_distinct(g.lecs)) < {len(_EARLY)}) ORDER BY c.dep_rank, c.pre_rank LIMIT 1"""


@query(f"""WITH RECURSIVE {BOTH_SQL}, {_LECTURES_SQL},
d AS (SELECT canonical, intro[1] AS lecture, intro[3] AS lec FROM nodes WHERE n_defs > 0 AND intro IS NOT NULL),
deps AS (SELECT *, row_number() OVER (ORDER BY canonical) - 1 AS dep_rank FROM d WHERE lec IN ({', '.join(map(str, _EARLY))})),
pres AS (SELECT *, row_number() OVER (ORDER BY lec, canonical) - 1 AS pre_rank FROM d WHERE lec >= 70),
cand AS MATERIALIZED (SELECT a.canonical AS dependent, p.canonical AS prerequisite, a.lecture, dep_rank, pre_rank FROM deps a JOIN pres p ON p.lec > a.lec AND p.canonical <> a.canonical
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = p.canonical AND e.dst = a.canonical OR e.src = a.canonical AND e.dst = p.canonical) AND NOT contains(coalesce((SELECT low FROM lectures l WHERE l.lecture = a.lecture), ''), {trade.plain_sql('p.canonical')})),
g(k, dependent, prerequisite, lecture, dep_rank, pre_rank, deps, pres, lecs) AS (
  SELECT 0, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, -1::BIGINT, -1::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[]
  UNION ALL SELECT g.k + 1, n.dependent, n.prerequisite, n.lecture, n.dep_rank, n.pre_rank, list_append(g.deps, n.dependent), list_append(g.pres, n.prerequisite), list_append(g.lecs, n.lecture) FROM g, LATERAL ({_CHOICE}) n WHERE g.k < 9)
SELECT dependent, prerequisite, lecture, k - 1 AS k FROM g WHERE k > 0""")
def trade_chosen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to be injected, chosen one after another so that none shares an end."""
    course = trade.Course(spark, sf_dir)
    flagged = spark.createDataFrame([], "prerequisite string, dependent string")
    found = inject.prerequisite_candidates(course.nodes, course.edges, lectures(course), flagged, inject.Plan(_EARLY, 70))
    return inject.greedy_pairs(found, 9, len(_EARLY))


@query(f"""WITH RECURSIVE {BOTH_SQL}, {_LECTURES_SQL}, d AS (SELECT place, canonical, intro[1] AS lecture, intro[3] AS lec FROM nodes WHERE n_defs > 0 AND intro IS NOT NULL),
p AS (SELECT a.canonical AS dependent, a.lecture, arg_min(b.canonical, (b.lec, b.place)) AS prerequisite FROM d a JOIN d b ON b.lec < a.lec AND b.canonical <> a.canonical LEFT JOIN lectures l ON l.lecture = a.lecture
  WHERE a.lec IN ({', '.join(map(str, _EARLY))}) AND NOT contains(coalesce(low, ''), {trade.plain_sql('b.canonical')}) GROUP BY 1, 2)
SELECT dependent, prerequisite, lecture, row_number() OVER (ORDER BY dependent) - 1 AS k FROM p ORDER BY dependent LIMIT 3""")
def trade_valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placebos: early concepts and the earliest one introduced before them."""
    course = trade.Course(spark, sf_dir)
    none = spark.createDataFrame([], "prerequisite string, dependent string")
    found = inject.valid_pairs(course.nodes, lectures(course), none, none, inject.Plan(_EARLY, 70))
    return found.select("dependent", "prerequisite", "lecture", F.col("k").cast("long").alias("k"))


@query(f"""WITH RECURSIVE {CONCEPTS_SQL} SELECT '- ' || canonical || CASE WHEN aliases = '' THEN '' ELSE ' (' || replace(aliases, '|', ', ') || ')' END AS value FROM with_aliases""")
def trade_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The course's concepts as lines of a vocabulary."""
    nodes, _ = trade.graph(spark, sf_dir)
    return sinks.vocabulary_text(nodes)


@query(rf"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT * FROM edges)
SELECT '<edge source="' || src || '" target="' || dst || '"><data key="reason">' || reason || '</data><data key="evidence_lecture">' || evidence_lecture || '</data><data key="evidence_unit">' || evidence_unit || '</data></edge>' AS value FROM e
UNION ALL SELECT '<node id="' || canonical || '"><data key="name_again">' || canonical || '</data></node>' FROM canon""")
def trade_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges as elements of GraphML."""
    nodes, edges = trade.graph(spark, sf_dir)
    slim = nodes.select("name", "place", F.col("name").alias("name_again"))
    return sinks.graphml(slim, edges.select("src", "dst", "reason", "evidence_lecture", "evidence_unit", "first_seq")).where("part in (1, 2)").select("value")


@query(f"""WITH {LINES_SQL} SELECT lecture, count(*) AS n_occurrences, count(*) FILTER (trim(name) = '') AS n_unnamed, count(role) AS n_roles FROM li GROUP BY 1""")
def trade_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each month's extraction holds."""
    rows = trade.extractions(spark, sf_dir)
    unnamed = F.size(F.filter("concepts", lambda c: text.strip(c["name"]) == ""))
    return rows.select(
        F.col("lecture_id").alias("lecture"), F.size("concepts").cast("long").alias("n_occurrences"), unnamed.cast("long").alias("n_unnamed"), F.size(F.filter("concepts", lambda c: c["role"].isNotNull())).cast("long").alias("n_roles"),
    )
