"""Experiments over the driver's tables: scores of injections, methods side by side, votes,
statistics, and whole courses with one lecture or the overrides changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import consensus, detect, evaluate, inject, keyword, resolve
from lectern.operators.concept_graph import appearances, build_nodes
from lectern.plans import trade
from lectern.plans.course import table
from lectern.plans.registry import query
from lectern.plans.trade import CONCEPTS_SQL, EDGES_SQL, LINES_SQL, MEMBERS_SQL, NODES_SQL, norm_sql

GRAPH_SQL = CONCEPTS_SQL + NODES_SQL
_TIER = "['blatant', 'medium', 'subtle'][({} % 3 + 1)::INT]"

# Signatures: parts of odd sizes are what detectors say of the clean course, the others what
# they say of a variant for each brand; each brand also names what was injected.

_SIGNATURES_SQL = """sig AS (SELECT DISTINCT CASE WHEN p_size % 2 = 1 THEN 'clean' ELSE p_brand END AS spec,
    CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'used_before_introduction' WHEN p_type = 'LARGE' THEN 'cyclic_dependency' ELSE 'orphan_concept' END AS type,
    CASE WHEN p_type IN ('STANDARD', 'MEDIUM', 'SMALL') THEN 'used_without_introduction' ELSE '' END AS subtype, p_name || ' ' || p_size // 10 AS concept FROM part),
specs AS (SELECT p_brand AS spec, CASE min(p_partkey) % 3 WHEN 0 THEN 'used_before_introduction' WHEN 1 THEN 'orphan_concept' ELSE 'placebo' END AS type,
    CASE WHEN min(p_partkey) % 3 = 2 THEN 'n/a' ELSE ['blatant', 'medium', 'subtle'][(count(*) % 3 + 1)::INT] END AS subtlety, 'The ' || arg_max(p_name, p_partkey) AS target FROM part GROUP BY 1),
fresh AS (SELECT * FROM sig s WHERE spec <> 'clean' AND NOT EXISTS (SELECT 1 FROM sig c WHERE c.spec = 'clean' AND c.type = s.type AND c.subtype = s.subtype AND c.concept = s.concept))"""


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'used_before_introduction' WHEN p_type = 'LARGE' THEN 'cyclic_dependency' ELSE 'orphan_concept' END")
    sub = F.expr("CASE WHEN p_type IN ('STANDARD', 'MEDIUM', 'SMALL') THEN 'used_without_introduction' ELSE '' END")
    spec = F.when(F.col("p_size") % 2 == 1, evaluate.CLEAN).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(spec.alias("spec"), kind.alias("type"), sub.alias("subtype"), F.concat("p_name", F.lit(" "), F.expr("p_size div 10")).alias("concept")).distinct()


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("spec")).agg(F.min("p_partkey").alias("m"), F.count("*").alias("n"), F.max_by("p_name", "p_partkey").alias("name"))
    kind = F.expr("CASE m % 3 WHEN 0 THEN 'used_before_introduction' WHEN 1 THEN 'orphan_concept' ELSE 'placebo' END")
    return rows.select("spec", kind.alias("type"), F.when(F.col("m") % 3 == 2, "n/a").otherwise(text.tier(F.col("n"))).alias("subtlety"), F.concat(F.lit("The "), "name").alias("target"))


@query(f"""WITH {_SIGNATURES_SQL}, j AS (SELECT s.*, f.type AS ft, f.concept, (f.type, f.subtype) IN (('used_before_introduction', ''), ('orphan_concept', 'used_without_introduction')) AS own,
  {norm_sql('target')} AS a, {norm_sql('concept')} AS b FROM specs s LEFT JOIN fresh f USING (spec)),
h AS (SELECT *, own AND ft = type AND (contains(a, b) OR contains(b, a)) AS hit FROM j)
SELECT spec, type, subtlety, target, coalesce(bool_or(hit), false) AS detected, min(concept) FILTER (hit) AS matched, count(*) FILTER (own) AS n_new_injected_types, count(ft) AS n_new_all FROM h GROUP BY ALL""")
def scored_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the new signatures of each variant hold what was injected."""
    return evaluate.score_concepts(_specs(spark, sf_dir), _signatures(spark, sf_dir))


@query(f"""WITH {_SIGNATURES_SQL}, f AS (SELECT spec, count(*) AS n_new FROM fresh GROUP BY 1), p AS (SELECT coalesce(n_new, 0) AS n FROM specs LEFT JOIN f USING (spec) WHERE type = 'placebo')
SELECT count(*) AS placebos, coalesce(sum(n), 0)::BIGINT AS new_signatures, coalesce(sum(n), 0) / greatest(1, count(*)) AS per_placebo FROM p""")
def placebo_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New signatures of the variants in which nothing was injected."""
    return evaluate.drift(evaluate.score_concepts(_specs(spark, sf_dir), _signatures(spark, sf_dir)), "n_new_all")


_PAIRS_SQL = """v AS (SELECT CASE WHEN a.p_size % 2 = 1 THEN 'clean' ELSE a.p_brand END AS spec, a.p_name AS prerequisite, b.p_name AS dependent, a.p_size % 3 = 0 AS transitive FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
specs AS (SELECT p_brand AS spec, CASE WHEN min(p_partkey) % 4 = 0 THEN 'placebo' ELSE 'prerequisite_order' END AS type, 'x' AS subtlety, 'The ' || arg_max(p_name, p_partkey) AS prerequisite, arg_min(p_name, p_partkey) AS dependent FROM part GROUP BY 1),
fresh AS (SELECT DISTINCT spec, prerequisite AS p, dependent AS d FROM v WHERE spec <> 'clean' AND (prerequisite, dependent) NOT IN (SELECT (prerequisite, dependent) FROM v WHERE spec = 'clean'))"""


@query(f"""WITH {_PAIRS_SQL}, m AS (SELECT s.*, f.p, f.d, type <> 'placebo' AND f.p IS NOT NULL AND (contains({norm_sql('s.prerequisite')}, {norm_sql('f.p')}) OR contains({norm_sql('f.p')}, {norm_sql('s.prerequisite')})) AND (contains({norm_sql('s.dependent')}, {norm_sql('f.d')}) OR contains({norm_sql('f.d')}, {norm_sql('s.dependent')})) AS hit
  FROM specs s LEFT JOIN fresh f USING (spec)),
x AS (SELECT DISTINCT s.spec FROM specs s JOIN v USING (spec) WHERE NOT transitive AND type <> 'placebo' AND (contains({norm_sql('s.prerequisite')}, {norm_sql('v.prerequisite')}) OR contains({norm_sql('v.prerequisite')}, {norm_sql('s.prerequisite')})) AND (contains({norm_sql('s.dependent')}, {norm_sql('v.dependent')}) OR contains({norm_sql('v.dependent')}, {norm_sql('s.dependent')})))
SELECT spec, type, prerequisite, dependent, coalesce(bool_or(hit), false) AS detected, count(p) AS n_new, spec IN (SELECT spec FROM x) AS direct_edge FROM m GROUP BY ALL""")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether new pairs of each variant hold the injected one, and whether directly."""
    a = table(spark, sf_dir, "part")
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("dependent"))
    spec = F.when(F.col("p_size") % 2 == 1, evaluate.CLEAN).otherwise(F.col("p_brand"))
    found = a.join(b, "p_partkey").select(spec.alias("spec"), F.col("p_name").alias("prerequisite"), "dependent", (F.col("p_size") % 3 == 0).alias("transitive"))
    rows = a.groupBy(F.col("p_brand").alias("spec")).agg(F.min("p_partkey").alias("m"), F.max_by("p_name", "p_partkey").alias("hi"), F.min_by("p_name", "p_partkey").alias("dependent"))
    specs = rows.select("spec", F.when(F.col("m") % 4 == 0, "placebo").otherwise("prerequisite_order").alias("type"), F.lit("x").alias("subtlety"), F.concat(F.lit("The "), "hi").alias("prerequisite"), "dependent")
    return evaluate.score_pairs(specs, evaluate.pair_signatures(found), found).drop("subtlety", "new_pairs")


# Methods side by side -----------------------------------------------------------------------

_METHODS_SQL = """s AS (SELECT o_orderkey AS id, ['used_before_introduction', 'orphan_concept', 'placebo'][(o_orderkey % 3 + 1)::INT] AS type, ['blatant', 'medium', 'subtle'][(o_custkey % 3 + 1)::INT] AS subtlety, o_orderpriority AS target, o_orderstatus, o_custkey FROM orders),
g AS (SELECT id, o_custkey % 2 = 0 AS detected FROM s WHERE o_orderstatus <> 'P'), k AS (SELECT id, o_custkey % 5 = 0 AS kw_detected FROM s WHERE o_orderstatus <> 'F'),
d AS (SELECT id, CASE WHEN o_custkey % 4 = 0 THEN ['1-urgent  now'] ELSE [] END AS used_before, CASE WHEN o_custkey % 4 < 2 THEN ['HIGH', 'low'] ELSE NULL END AS orphans FROM s WHERE o_orderstatus <> 'O')"""
_SPACED = r"trim(regexp_replace(lower(trim({})), '\s+', ' ', 'g'))"


@query(f"""WITH {_METHODS_SQL}, j AS (SELECT s.id, type, subtlety, target, coalesce(g.detected, false) AS graph, coalesce(kw_detected, false) AS keyword, d.id IS NOT NULL AS there, CASE WHEN type = 'used_before_introduction' THEN used_before ELSE orphans END AS said
  FROM s LEFT JOIN g USING (id) LEFT JOIN k USING (id) LEFT JOIN d USING (id) WHERE type <> 'placebo')
SELECT id, type, subtlety, target, graph, keyword, CASE WHEN there THEN len(list_filter(coalesce(said, []), lambda t: contains({_SPACED.format('target')}, {_SPACED.format('t')}) OR contains({_SPACED.format('t')}, {_SPACED.format('target')}))) > 0 END AS llm_direct FROM j""")
def compared_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three methods' results of each spec; what a method has no result of is a miss or unknown."""
    s = _method_specs(spark, sf_dir)
    graph = s.where("o_orderstatus <> 'P'").select("id", (F.col("o_custkey") % 2 == 0).alias("detected"))
    words = s.where("o_orderstatus <> 'F'").select("id", (F.col("o_custkey") % 5 == 0).alias("kw_detected"))
    direct = s.where("o_orderstatus <> 'O'").select(
        "id", F.expr("CASE WHEN o_custkey % 4 = 0 THEN array('1-urgent  now') ELSE array() END").cast("array<string>").alias("used_before"), F.expr("CASE WHEN o_custkey % 4 < 2 THEN array('HIGH', 'low') END").alias("orphans")
    )
    return evaluate.compare_methods(s, graph, words, direct)


def _method_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["used_before_introduction", "orphan_concept", "placebo"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("type"), text.tier(F.col("o_custkey")).alias("subtlety"), F.col("o_orderpriority").alias("target"), "o_orderstatus", "o_custkey")


@query(f"""WITH {_METHODS_SQL}, c AS (SELECT s.id, subtlety, target AS prerequisite, o_orderstatus AS dependent, coalesce(detected, false) AS graph, o_orderstatus <> 'O' AS there, o_custkey FROM s LEFT JOIN g USING (id) WHERE type <> 'placebo')
SELECT id, subtlety, prerequisite, dependent, graph, CASE WHEN there THEN (o_custkey % 4 = 0 AND contains(lower(prerequisite), 'high') AND dependent = 'F') END AS llm_direct FROM c""")
def compared_pair_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods' results of each pair."""
    s = _method_specs(spark, sf_dir).withColumnRenamed("target", "prerequisite").withColumn("dependent", F.col("o_orderstatus"))
    graph = s.where("o_orderstatus <> 'P'").select("id", (F.col("o_custkey") % 2 == 0).alias("detected"))
    said = F.array(F.struct(F.lit(" f ").alias("dependent"), F.lit("High").alias("prerequisite")))
    direct = s.where("o_orderstatus <> 'O'").select("id", F.when(F.col("o_custkey") % 4 == 0, said).alias("violations"))
    return evaluate.compare_pair_methods(s, graph, direct)


@query(f"""WITH d AS (SELECT DISTINCT p_brand AS spec, p_name AS term, CASE WHEN p_size % 2 = 0 THEN 'orphan_concept' ELSE 'used_before_introduction' END AS kind FROM part),
s AS (SELECT p_brand AS spec, CASE min(p_partkey) % 3 WHEN 0 THEN 'used_before_introduction' WHEN 1 THEN 'orphan_concept' ELSE 'placebo' END AS type, upper(arg_max(p_name, p_partkey)) || '  x' AS target FROM part GROUP BY 1)
SELECT spec, type, target, CASE WHEN type <> 'placebo' THEN EXISTS (SELECT 1 FROM d WHERE d.spec = s.spec AND d.kind = s.type AND (contains({_SPACED.format('s.target')}, {_SPACED.format('d.term')}) OR contains({_SPACED.format('d.term')}, {_SPACED.format('s.target')}))) END AS kw_detected FROM s""")
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the keyword baseline finds each brand's target."""
    part = table(spark, sf_dir, "part")
    found = part.select(F.col("p_brand").alias("spec"), F.col("p_name").alias("term"), F.when(F.col("p_size") % 2 == 0, "orphan_concept").otherwise("used_before_introduction").alias("kind")).distinct()
    rows = part.groupBy(F.col("p_brand").alias("spec")).agg(F.min("p_partkey").alias("m"), F.max_by("p_name", "p_partkey").alias("name"))
    specs = rows.select("spec", F.expr("CASE m % 3 WHEN 0 THEN 'used_before_introduction' WHEN 1 THEN 'orphan_concept' ELSE 'placebo' END").alias("type"), F.concat(F.upper("name"), F.lit("  x")).alias("target"))
    return keyword.keyword_hits(specs, found)


# Votes and statistics -----------------------------------------------------------------------


@query(r"""WITH e AS (SELECT DISTINCT p_brand AS lecture_id, p_size % 5 + 1 AS run, p_type AS f, p_name || CASE WHEN p_size % 2 = 0 THEN ' (x)' ELSE '' END AS t FROM part),
v AS (SELECT lecture_id, f, regexp_replace(t, ' \(x\)$', '') AS t, count(DISTINCT run) AS votes FROM e GROUP BY 1, 2, 3 HAVING count(DISTINCT run) >= 2)
SELECT e.lecture_id, count(DISTINCT run)::INT AS n_runs, 2 AS votes_required, (SELECT count(*) FROM v WHERE v.lecture_id = e.lecture_id)::INT AS n_edges FROM e GROUP BY 1""")
def consensus_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that two runs or more of a brand have, and how many runs it has."""
    end = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " (x)").otherwise(""))
    edge = F.struct(F.col("p_type").alias("from"), end.alias("to"), F.lit("r").alias("reason"), F.lit("").alias("evidence_unit"))
    runs = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("lecture_id"), (F.col("p_size") % 5 + 1).alias("run")).agg(F.array_sort(F.collect_set(edge)).alias("prerequisites"))
    return consensus.consensus(runs, 2).select("lecture_id", "n_runs", "votes_required", F.size("prerequisites").alias("n_edges"))


_Z = 1.959963984540054


@query(f"""WITH l AS (SELECT lang AS course, quality, toxic FROM labels JOIN documents USING (doc_id)),
m AS (SELECT 'temporal_graph' AS method, count(*) FILTER (quality = 1) AS hits, count(*) AS trials FROM l UNION ALL SELECT 'direct_model', count(*) FILTER (toxic = 0), count(*) FROM l),
w AS (SELECT *, hits::DOUBLE / trials AS p, 1 + {_Z} * {_Z} / trials AS width FROM m),
r AS (SELECT 'temporal_graph' AS method, course, count(*) AS flagged, count(*) FILTER (quality = 1 AND toxic = 0) AS confirmed FROM l GROUP BY 2 UNION ALL SELECT 'direct_model', course, count(*), count(*) FILTER (toxic = 0) FROM l GROUP BY 2),
a AS (SELECT method, avg(confirmed / flagged) AS macro, sum(confirmed) / sum(flagged) AS micro, sum(confirmed)::BIGINT AS confirmed, sum(flagged)::BIGINT AS flagged FROM r GROUP BY 1)
SELECT method, hits, trials, round(greatest(0, ((p + {_Z} * {_Z} / (2 * trials)) / width) - {_Z} * sqrt(p * (1 - p) / trials + {_Z} * {_Z} / (4 * trials * trials)) / width), 6) AS low,
  round(least(1, ((p + {_Z} * {_Z} / (2 * trials)) / width) + {_Z} * sqrt(p * (1 - p) / trials + {_Z} * {_Z} / (4 * trials * trials)) / width), 6) AS high, round(macro, 6) AS macro, round(micro, 6) AS micro, confirmed, flagged FROM w JOIN a USING (method)""")
def method_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall with its interval and both mean precisions of two methods, from consistent counts."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumns({"g": F.col("quality") == 1, "d": F.col("toxic") == 0})
    by = rows.groupBy(F.col("lang").alias("course")).agg(F.count_if("g").alias("g"), F.count_if("d").alias("d"), F.count_if(F.col("g") & F.col("d")).alias("both"), F.count("*").alias("n"))
    recall = by.select("course", F.col("n").alias("trials"), F.explode(F.map_from_arrays(F.array(F.lit("temporal_graph"), F.lit("direct_model")), F.array("g", "d"))).alias("method", "hits"))
    precision = by.select("course", F.col("n").alias("flagged"), F.explode(F.map_from_arrays(F.array(F.lit("temporal_graph"), F.lit("direct_model")), F.array("both", "d"))).alias("method", "confirmed"))
    paired = by.agg(F.sum("both").alias("both_identified"), F.sum(F.col("g") - F.col("both")).alias("temporal_graph_only"), F.sum(F.col("d") - F.col("both")).alias("direct_model_only"), F.sum(F.col("n") - F.col("g") - F.col("d") + F.col("both")).alias("both_missed"))
    found = evaluate.statistics(recall, precision, paired)
    return found.select("method", "hits", "trials", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"), "confirmed", "flagged")


# Names --------------------------------------------------------------------------------------


@query(f"""WITH n AS (SELECT a.p_partkey, 'The ' || a.p_name AS x, b.p_name || '!' AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 UNION ALL SELECT p_partkey + 1000000000, p_name, ' ' || upper(p_name) || '  ' || p_size FROM part),
k AS (SELECT *, {norm_sql('x')} AS a, {norm_sql('y')} AS b, {_SPACED.format('x')} AS c, {_SPACED.format('y')} AS d FROM n)
SELECT p_partkey AS key, contains(a, b) OR contains(b, a) AS names, contains(c, d) OR contains(d, c) AS spaced FROM k""")
def matching_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two names hold one another, by both normalisers."""
    part = table(spark, sf_dir, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.lit("!")).alias("y"))
    pairs = part.join(after, "p_partkey").select("p_partkey", F.concat(F.lit("The "), "p_name").alias("x"), "y")
    sized = part.select((F.col("p_partkey") + 1000000000).alias("p_partkey"), F.col("p_name").alias("x"), F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "), "p_size").alias("y"))
    return pairs.unionByName(sized).select(F.col("p_partkey").alias("key"), text.names_match(F.col("x"), F.col("y")).alias("names"), text.spaced_names_match(F.col("x"), F.col("y")).alias("spaced"))


@query("SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1)::INT AS number FROM customer")
def customer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a customer's name."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.lecture_number(F.col("c_name")).alias("number"))


@query("""SELECT p_partkey, to_json([p_name, p_brand])::VARCHAR AS list, CASE WHEN p_size > 10 THEN 'True' ELSE 'False' END AS flag, CASE WHEN p_size = 1 THEN '' ELSE p_size::VARCHAR END AS number, to_json({'n': p_name})::VARCHAR AS record FROM part""")
def flat_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every kind as strings."""
    part = table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") != 1, F.col("p_size"))
    return part.select(
        "p_partkey", text.flat(F.array("p_name", "p_brand"), "array<string>").alias("list"), text.flat(F.col("p_size") > 10, "boolean").alias("flag"), text.flat(size, "int").alias("number"), text.flat(F.struct(F.col("p_name").alias("n")), "struct<n:string>").alias("record"),
    )


@query(f"WITH {LINES_SQL} SELECT DISTINCT regexp_replace(regexp_replace(t, '^[ :—–-]+', ''), '[ :—–-]+$', '') AS term FROM (SELECT CASE l_linenumber WHEN 1 THEN ' — ' || base || ': ' WHEN 2 THEN '12' WHEN 3 THEN ': -' ELSE name || ' –' END AS t FROM li) WHERE term <> '' AND NOT regexp_full_match(term, '[0-9]+')")
def cleaned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary terms without spaces, colons and dashes around them."""
    raw = F.expr("CASE l_linenumber WHEN 1 THEN concat(' — ', base, ': ') WHEN 2 THEN '12' WHEN 3 THEN ': -' ELSE concat(name, ' –') END")
    return trade.lines(spark, sf_dir).select(text.cleaned_term(raw).alias("term")).where("term is not null").distinct()


# Whole courses ------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {GRAPH_SQL} SELECT c.canonical AS name, s.lecture, count(*) AS n, count(*) FILTER (fwd) AS n_forward FROM seen s JOIN canon c USING (place) GROUP BY 1, 2")
def trade_forward_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearances of each concept in each lecture, and those that are but forward references."""
    course = trade.Course(spark, sf_dir)
    rows = appearances(course.resolved.concepts, course.units)
    return rows.groupBy("name", "lecture").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("forward_ref"), F.col("n")).otherwise(0)).alias("n_forward"))


_SIGNED = "SELECT 'used_before_introduction' AS type, canonical AS concept FROM nodes WHERE intro IS NOT NULL AND (used[3], used[4]) < (intro[3], intro[4]) UNION ALL SELECT 'orphan_concept', canonical FROM nodes WHERE n_introduced = 0 AND n_used > 0"


@query(f"WITH RECURSIVE {GRAPH_SQL} {_SIGNED}")
def trade_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two concept detectors find, together."""
    return evaluate.concept_signatures(trade.graph(spark, sf_dir)[0]).select("type", "concept")


#: A variant: in the tenth month, lines of number 1 speak of something new, which comes last.
_SWAPPED_SQL = GRAPH_SQL.replace("CASE WHEN l_tax = 0.08 AND l_linenumber = 7 THEN p_name", "CASE WHEN lec = 10 AND l_linenumber = 1 THEN 'Canary release' WHEN l_tax = 0.08 AND l_linenumber = 7 THEN p_name").replace(
    "row_number() OVER (ORDER BY li.lec, i) - 1 AS occ_id", "row_number() OVER (ORDER BY li.lec = 10, li.lec, i) - 1 AS occ_id"
)


@query(f"SELECT * FROM (WITH RECURSIVE {_SWAPPED_SQL} {_SIGNED}) EXCEPT SELECT * FROM (WITH RECURSIVE {GRAPH_SQL} {_SIGNED})")
def trade_injected_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What detectors find in a variant of the course that the clean one lacks."""
    course = trade.Course(spark, sf_dir)
    clean = course.said
    name = F.when(F.col("first_mentioned_unit").endswith("#01"), "Canary release").otherwise(F.col("name"))
    swapped = clean.where("lecture = 'm10'").withColumns({"spec": F.lit("v"), "name": name})
    occs = resolve.occurrences(evaluate.variant_rows(clean, swapped, "lecture"), "pos", "at")
    nodes, _ = evaluate.graphs_stated(occs, course.raw.limit(0), course.units, trade.overrides(spark, sf_dir))
    return evaluate.new_signatures(evaluate.concept_signatures(nodes)).select("type", "concept")


_AUDITED_SQL = CONCEPTS_SQL.replace("WHERE p_type = 'SMALL' AND p_size = 4)", "WHERE p_type = 'SMALL' AND p_size = 4 UNION SELECT 'blue rod 1' UNION SELECT 'blue anvil 12')").replace(
    "WHERE p_type = 'MEDIUM' AND p_size = 2)", "WHERE p_type = 'MEDIUM' AND p_size = 2 UNION ALL SELECT 'new', unnest(['blue anvil 1', 'cold anvil 23', 'blue anvil 21']))"
)
_ORPHANS = "SELECT canonical AS concept FROM concepts WHERE n_introduced = 0 AND n_used > 0"


@query(f"""WITH a AS (SELECT * FROM (WITH RECURSIVE {CONCEPTS_SQL} {_ORPHANS})), b AS (SELECT * FROM (WITH RECURSIVE {_AUDITED_SQL} {_ORPHANS}))
SELECT concept, 'removed' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT concept, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def trade_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans that further overrides remove and add."""
    decisions = spark.createDataFrame([([["blue anvil 1", "cold anvil 23", "blue anvil 21"], ["blue anvil 21", "blue anvil 1", "cold anvil 23"]], ["Blue rod 1!", "blue anvil 12"])], "merge_groups array<array<string>>, exclude array<string>")
    return evaluate.audit(trade.saved(trade.extractions(spark, sf_dir)), trade.manifest(spark, sf_dir), None, trade.overrides(spark, sf_dir), decisions)[1]


@query(f"""WITH RECURSIVE {CONCEPTS_SQL}, s AS (SELECT unnest(['c1', 'c2', 'c3']) AS id, unnest(['The red widget 28', 'widget 1', 'nothing']) AS concept),
m AS (SELECT s.id, s.concept, c.*, row_number() OVER (PARTITION BY s.id ORDER BY ({norm_sql('canonical')} = {norm_sql('s.concept')}) DESC, place) AS r FROM s JOIN concepts c ON contains({norm_sql('canonical')}, {norm_sql('s.concept')}))
SELECT s.id, s.concept, coalesce(n_defs >= 2 AND n_def_lectures >= 2, false) AS is_candidate, coalesce(n_defs, 0)::INT AS n_defs FROM s LEFT JOIN m ON m.id = s.id AND r = 1""")
def trade_conflict_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be verified of three named concepts."""
    specs = spark.createDataFrame([(evaluate.CLEAN, i, "conflict", c, "blatant") for i, c in (("c1", "The red widget 28"), ("c2", "widget 1"), ("c3", "nothing"))], "spec string, id string, kind string, concept string, subtlety string")
    return evaluate.conflict_tasks(specs, trade.resolved(spark, sf_dir).concepts).select("id", "concept", "is_candidate", "n_defs")


@query(f"""WITH RECURSIVE {MEMBERS_SQL}, links AS (SELECT lecture, lower(string_agg(text, ' ' ORDER BY unit)) AS low FROM unit_text GROUP BY 1),
n AS (SELECT c.place, canonical, arg_min(definition, occ_id) FILTER (role = 'introduced' AND definition <> '') AS def, arg_min(lecture, (lo, un, occ_id)) FILTER (role = 'introduced') AS lecture_introduced FROM canon c JOIN members m USING (cluster) GROUP BY 1, 2),
w AS (SELECT unnest(range(3)) AS k, unnest(['cold anvil 23', 'old widget 43', 'red plate 21']) AS name)
SELECT printf('cinj-%03d', k + 1) AS id, name AS concept, def AS real_definition, lecture_introduced AS intro_lecture, arg_min(man.lecture, lec) AS insert_lecture, {_TIER.format('k')} AS subtlety FROM w JOIN n ON canonical = name AND def IS NOT NULL
  JOIN man ON man.lecture <> lecture_introduced LEFT JOIN links l ON l.lecture = man.lecture WHERE NOT contains(coalesce(low, ''), name) GROUP BY ALL""")
def trade_picked_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts picked by hand, with the first other lecture that doesn't name the concept."""
    from lectern.plans.trade_queries import lectures

    course = trade.Course(spark, sf_dir)
    found = inject.picked_conflicts(course.nodes, lectures(course), ["cold anvil 23", "old widget 43", "red plate 21"])
    return found.drop("type")


@query(f"""WITH RECURSIVE {CONCEPTS_SQL} SELECT (SELECT count(*) FROM ({_SIGNED.replace('nodes', 'stamped').split(' UNION ALL ')[0]})) AS used_before_introduction, 0::BIGINT AS prerequisite_order,
  (SELECT count(*) FROM concepts WHERE n_defs >= 2 AND n_def_lectures >= 2) AS definition_conflicts, (SELECT count(*) FROM ({_ORPHANS})) AS orphan_concepts, 0::BIGINT AS cycles
FROM (SELECT 1) t""".replace("FROM stamped", "FROM (SELECT c.*, (SELECT arg_min((lecture, unit, lo, un), (lo, un, occ_id)) FROM members m WHERE m.cluster = c.cluster AND role = 'used') AS used FROM concepts c)"))
def trade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detectors' counts for the course without its prerequisites."""
    nodes = trade.saved(build_nodes(trade.resolved(spark, sf_dir).concepts))
    none = spark.createDataFrame([], "spec string, src string, dst string")
    found = detect.run_detectors(nodes, none)["counts"]
    return found.select("used_before_introduction", "prerequisite_order", "definition_conflicts", "orphan_concepts", "cycles")


# One edge more -------------------------------------------------------------------------------

_PAIR = ("old widget 43", "cold anvil 23")
_LATE_SQL = "SELECT e.src AS prerequisite, e.dst AS dependent FROM edges e JOIN nodes a ON a.canonical = e.src JOIN nodes b ON b.canonical = e.dst WHERE a.intro IS NOT NULL AND b.intro IS NOT NULL AND (a.intro[3], a.intro[4]) > (b.intro[3], b.intro[4])"
_BOTH_SQL = GRAPH_SQL + EDGES_SQL.removeprefix(MEMBERS_SQL)


def _appended(prerequisite: str, dependent: str) -> str:
    """The chain's SQL with the tenth month last, and one more edge stated there."""
    late = _BOTH_SQL.replace("row_number() OVER (ORDER BY li.lec, i) - 1 AS occ_id", "row_number() OVER (ORDER BY li.lec = 10, li.lec, i) - 1 AS occ_id")
    late = late.replace("row_number() OVER (ORDER BY a.lec, a.i, b.i) - 1 AS seq", "row_number() OVER (ORDER BY a.lec = 10, a.lec, a.i, b.i) - 1 AS seq")
    joined = "FROM li a JOIN li b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"
    return late.replace(joined, joined[:-1] + f" UNION ALL SELECT 1000000000, '{prerequisite}', '{dependent}', 'injected dependency (minimal control)', '10#01', 'm10')")


@query(" UNION ALL ".join(
    f"SELECT 'v{k}' AS spec, * FROM (SELECT * FROM (WITH RECURSIVE {_appended(*pair)} {_LATE_SQL}) EXCEPT SELECT * FROM (WITH RECURSIVE {_BOTH_SQL} {_LATE_SQL}))" for k, pair in enumerate((_PAIR, _PAIR[::-1]))
))
def trade_minimal_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct violations that one appended edge brings, either way round."""
    course = trade.Course(spark, sf_dir)
    said, stated = course.said, trade.saved(course.stated.select("spec", "seq", "from", "to", "reason", "evidence_unit", "evidence_lecture", "n", "last"))
    rows = [(f"v{k}", "m10", a, b, "10#01") for k, (a, b) in enumerate((_PAIR, _PAIR[::-1]))]
    specs = spark.createDataFrame(rows, "spec string, lecture string, prerequisite string, dependent string, insert_unit string")
    own = F.broadcast(specs.select("spec", "lecture"))
    occs = evaluate.variant_rows(said, said.drop("spec").join(own, "lecture"), "lecture")
    raw = evaluate.variant_edges(stated, specs)
    nodes, edges = evaluate.graphs_stated(resolve.occurrences(occs, "pos", "at"), resolve.stated(raw), None, trade.overrides(spark, sf_dir))
    late = detect.prerequisite_order(trade.saved(nodes), edges, transitive=False)
    return evaluate.new_signatures(evaluate.pair_signatures(late)).select("spec", "prerequisite", "dependent")


@query(f"""WITH {LINES_SQL} SELECT a.lecture AS lecture_id, (count(*) FILTER (a.lec >= 40 AND b.lec IS NOT NULL))::INT AS n_edges FROM li a LEFT JOIN li b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1""")
def trade_replaced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions whose prerequisites are replaced by those of the later lectures alone."""
    clean = trade.extractions(spark, sf_dir)
    later = clean.where("pos >= 40").select("lecture_id", "prerequisites")
    none = F.coalesce(F.size("prerequisites"), F.lit(0))
    return evaluate.with_edges(clean, later).select("lecture_id", F.greatest(none, F.lit(0)).alias("n_edges"))


@query(f"""WITH {LINES_SQL}, t AS (SELECT DISTINCT base AS term FROM li WHERE l_linenumber = 3)
SELECT term, arg_min(u.lecture, (m.lec, u.unit)) AS first_lecture, arg_min(u.unit, (m.lec, u.unit)) AS first_unit FROM t LEFT JOIN (unit_text u JOIN man m ON m.lecture = u.lecture) ON contains(lower(text), lower(term)) GROUP BY 1""")
def trade_first_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unit that names each part sold on a third line."""
    terms = trade.lines(spark, sf_dir).where("l_linenumber = 3").select(F.col("base").alias("term")).distinct()
    own = trade.units(spark, sf_dir).join(trade.manifest(spark, sf_dir).withColumnRenamed("lecture_id", "lecture"), "lecture")
    return keyword.first_units(terms, own.select("lecture_order", "lecture", F.col("unit").alias("i"), "unit", "text"))


@query("""SELECT a.vec_id, round(CASE WHEN a.vec_id % 7 = 0 THEN 0.0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 5) AS likeness FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each vector and the next; every seventh is compared with a vector without length."""
    rows = table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    nothing = F.transform("other", lambda x: x * 0)
    other = F.when(F.col("vec_id") % 7 == 0, nothing).otherwise(F.col("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), other), 5).alias("likeness"))
