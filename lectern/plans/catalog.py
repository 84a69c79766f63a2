"""Queries over the driver's tables, each a column mapping onto the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import stats, text
from lectern.operators import cycles, detect, evaluate, graph, keyword, paths, quality, resolve, segment
from lectern.operators.concept_graph import build_nodes, last_edge
from lectern.operators.consensus import vote, vote_edges
from lectern.operators.inject import numbered
from lectern.plans import course as c
from lectern.plans import brand_queries, customer_queries, experiment_queries, file_queries, trade_queries  # noqa: F401  register their queries
from lectern.plans.course import OCC_SQL, STATED_SQL, UNITS_SQL
from lectern.plans.registry import ORACLES, QUERIES, query
from lectern.sources.course import read_overrides
from lectern.sources.sinks import course_text

# Concepts in conversations -----------------------------------------------------------------


@query(f"""WITH {OCC_SQL},
t AS (SELECT concept, min((conv_id, turn)) FILTER (role = 'assistant') AS intro, min((conv_id, turn)) FILTER (role = 'user') AS used FROM occ GROUP BY 1)
SELECT t.concept, t.used[1] AS used_conv, t.used[2] AS used_turn, t.intro[1] AS intro_conv, t.intro[2] AS intro_turn, count(*) AS n_used_before
FROM t JOIN occ o ON o.concept = t.concept AND o.role = 'user' AND (o.conv_id, o.turn) < t.intro WHERE t.used < t.intro GROUP BY ALL""")
def used_before_introduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.earliest_before(c.occurrences(spark, sf_dir), ["concept"], c.at(), c.introduced(), c.used())
    return found.select(
        "concept", F.col("used_at.conv_id").alias("used_conv"), F.col("used_at.turn").alias("used_turn"), F.col("intro.conv_id").alias("intro_conv"), F.col("intro.turn").alias("intro_turn"), "n_used_before",
    )


@query(f"WITH {OCC_SQL} SELECT concept, count(*) AS n_used FROM occ GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') = 0 AND count(*) FILTER (role = 'user') > 0")
def orphan_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.never_introduced(c.occurrences(spark, sf_dir), ["concept"], c.introduced(), c.used())


@query(f"WITH {OCC_SQL} SELECT concept, min((conv_id, turn))[1] AS conv, min((conv_id, turn))[2] AS turn FROM occ GROUP BY 1")
def first_use_any_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = c.occurrences(spark, sf_dir).groupBy("concept").agg(F.min(c.at()).alias("at"))
    return first.select("concept", F.col("at.conv_id").alias("conv"), F.col("at.turn").alias("turn"))


@query(f"""WITH {OCC_SQL}, half AS (SELECT max(conv_id) // 2 AS m FROM conversations)
SELECT DISTINCT concept FROM occ, half WHERE conv_id > m EXCEPT SELECT concept FROM occ, half WHERE conv_id <= m""")
def new_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of the later half of conversations that the earlier half lacks."""
    middle = c.table(spark, sf_dir, "conversations").agg(F.floor(F.max("conv_id") / 2).alias("m"))
    rows = c.occurrences(spark, sf_dir).join(F.broadcast(middle)).withColumn("spec", F.when(F.col("conv_id") <= F.col("m"), evaluate.CLEAN).otherwise("later"))
    return evaluate.new_signatures(rows.select("spec", "concept")).select("concept")


@query(f"""WITH {OCC_SQL}, half AS (SELECT max(conv_id) // 2 AS m FROM conversations),
a AS (SELECT concept FROM occ, half WHERE conv_id <= m GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') = 0),
b AS (SELECT concept FROM occ GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') = 0)
SELECT concept, 'removed' AS side FROM (SELECT concept FROM a EXCEPT SELECT concept FROM b) UNION ALL
SELECT concept, 'added' AS side FROM (SELECT concept FROM b EXCEPT SELECT concept FROM a)""")
def orphan_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans that the later half of conversations removes and adds."""
    middle = c.table(spark, sf_dir, "conversations").agg(F.floor(F.max("conv_id") / 2).alias("m"))
    rows = c.occurrences(spark, sf_dir)
    early = rows.join(F.broadcast(middle)).where("conv_id <= m")

    def orphans(df: DataFrame) -> DataFrame:
        return detect.never_introduced(df, ["concept"], c.introduced(), c.used()).select("concept")

    return evaluate.delta(orphans(early), orphans(rows))


@query("""SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role)) AS digest, count(*) AS n_turns FROM conversations GROUP BY 1""")
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "conversations")
    whole = course_text(rows, ("conv_id",), "turn", "role")
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return whole.join(counts, "conv_id").select("conv_id", F.md5("text").alias("digest"), "n_turns")


# Definitions -------------------------------------------------------------------------------


@query("""WITH d AS (SELECT label, vec_id, vec_id % 10 AS lecture, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.label, count(*) AS n_pairs, round(least(1.0, min(list_cosine_similarity(a.e, b.e))), 5) AS min_sim
FROM d a JOIN d b ON a.label = b.label AND a.vec_id < b.vec_id AND a.lecture <> b.lecture GROUP BY 1 HAVING min(list_cosine_similarity(a.e, b.e)) < -0.40""")
def definition_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.least_similar(c.definitions(spark, sf_dir), "label", "vec_id", "lecture", "embedding")
    return found.where("min_sim < -0.40").select("label", "n_pairs", F.round("min_sim", 5).alias("min_sim"))


@query("SELECT label, count(*) AS n_defs, count(DISTINCT vec_id % 10) AS n_lectures FROM embeddings GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT vec_id % 10) >= 2")
def conflict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.conflict_candidates(c.definitions(spark, sf_dir), "label", "lecture")


@query("""WITH d AS (SELECT label, vec_id, vec_id % 10 AS lecture, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT a.label, min(list_cosine_similarity(a.e, b.e)) AS s FROM d a JOIN d b ON a.label = b.label AND a.vec_id < b.vec_id AND a.lecture <> b.lecture GROUP BY 1)
SELECT concat('label ', label) AS concept, (SELECT count(*) FROM d WHERE d.label = m.label) AS definition_count, (SELECT count(DISTINCT lecture) FROM d WHERE d.label = m.label) AS lecture_count,
  round(least(1.0, s), 4) AS semantic_similarity FROM m WHERE s < 0.82""")
def verified_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as concepts, each vector a definition: conflict candidates, then the verdict."""
    rows = c.definitions(spark, sf_dir).withColumn("name", F.format_string("label %d", "label"))
    listed = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("vec_id", "lecture"))).alias("definitions"))
    nodes = listed.withColumn("spec", F.lit("clean"))
    places = nodes.select("spec", F.col("name").alias("concept"), F.posexplode("definitions").alias("i", "d"))
    vectors = places.join(rows.select("vec_id", F.col("embedding").alias("vector")), F.col("d.vec_id") == F.col("vec_id")).select("spec", "concept", "i", "vector")
    found = detect.verified_conflicts(detect.definition_conflicts(nodes), vectors)
    return found.select("concept", F.col("definition_count").cast("long").alias("definition_count"), F.col("lecture_count").cast("long").alias("lecture_count"), "semantic_similarity")


# Prerequisite edges ------------------------------------------------------------------------


@query(f"WITH {STATED_SQL} SELECT e.src, e.dst FROM edges e JOIN intro a ON a.node = e.src JOIN intro b ON b.node = e.dst WHERE a.at > b.at")
def prereq_order_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.later_than(c.edges(spark, sf_dir), c.introductions(spark, sf_dir), "node", "at").select("src", "dst")


@query(f"WITH RECURSIVE {STATED_SQL}, t(f, t) AS (SELECT src, dst FROM edges UNION SELECT t.f, e.dst FROM t JOIN edges e ON e.src = t.t) SELECT f, t FROM t")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitive_closure(c.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {STATED_SQL}, t(f, t) AS (SELECT src, dst FROM edges UNION SELECT t.f, e.dst FROM t JOIN edges e ON e.src = t.t)
SELECT f AS src, t AS dst, NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = f AND e.dst = t) AS is_transitive
FROM t JOIN intro a ON a.node = f JOIN intro b ON b.node = t WHERE f <> t AND a.at > b.at""")
def prereq_order_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.late_ancestors(c.edges(spark, sf_dir), c.introductions(spark, sf_dir), "node", "at")
    return found.select(F.col("f").alias("src"), F.col("t").alias("dst"), F.col("transitive").alias("is_transitive"))


@query(f"WITH {STATED_SQL} SELECT src, dst, max((l_orderkey, l_linenumber, date))[1] AS l_orderkey, max((l_orderkey, l_linenumber, date))[2] AS l_linenumber FROM stated GROUP BY 1, 2")
def edge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_edge(c.stated_edges(spark, sf_dir), "src", "dst", ["l_orderkey", "l_linenumber", "date"], ["l_orderkey", "l_linenumber"])


#: Steps of the SQL; by then ranks of so dense a graph no longer move.
_STEPS = 24
_RANK_SQL = f"WITH {STATED_SQL}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), deg AS (SELECT src, count(*) AS k FROM edges GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS MATERIALIZED (SELECT node, 1 / n AS r FROM nodes, n)" + "".join(
    f""", r{i + 1} AS MATERIALIZED (
  SELECT v.node, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM deg)) / n) AS r
  FROM nodes v CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(p.r / d.k) AS got FROM edges e JOIN deg d ON d.src = e.src JOIN r{i} p ON p.node = e.src GROUP BY 1) g ON g.dst = v.node)"""
    for i in range(_STEPS)
)


@query(f"{_RANK_SQL} SELECT node, round(r / max(r) OVER (), 4) AS importance FROM r{_STEPS}")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = c.edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.importance(edges, nodes, tolerance=1e-12).select("node", F.round("importance", 4).alias("importance"))


@query(f"""WITH RECURSIVE {STATED_SQL}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
t(node, m) AS (SELECT a, b FROM b UNION SELECT t.node, b.b FROM t JOIN b ON b.a = t.m) SELECT node, least(node, min(m)) AS component FROM t GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(c.edges(spark, sf_dir))


@query(f"""WITH {STATED_SQL}
SELECT a.src || '>' || a.dst AS path FROM edges a JOIN edges b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL
SELECT a.src || '>' || a.dst || '>' || b.dst FROM edges a JOIN edges b ON a.dst = b.src JOIN edges d ON d.src = b.dst AND d.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def short_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of up to three nodes, from their least node."""
    return cycles.simple_cycles(c.edges(spark, sf_dir), 3).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH RECURSIVE {STATED_SQL}, t(f, t) AS (SELECT src, dst FROM edges UNION SELECT t.f, e.dst FROM t JOIN edges e ON e.src = t.t) SELECT f AS node FROM t WHERE f = t""")
def nodes_on_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.nodes_on_cycles(c.edges(spark, sf_dir))


# Votes and vocabulary ----------------------------------------------------------------------


@query("""WITH t AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{4,}')) AS token FROM documents)
SELECT token, count(*) AS n_runs FROM t GROUP BY 1 HAVING count(*) >= 15""")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that at least 15 of the 20 sources have."""
    docs = c.table(spark, sf_dir, "documents")
    rows = docs.select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(c.TOKEN), F.lit(0)))).alias("token"))
    return vote(rows, ["token"], "source", 15)


@query()
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate term of the documents; tested against a brute-force version."""
    return keyword.vocabulary(c.table(spark, sf_dir, "documents"), "doc_id", "text")


_BENCHMARK_TERMS = r"[A-Z][A-Za-z]{3,}"
_FIRST_SQL = r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][A-Za-z]{3,}')) AS term FROM benchmark),
m AS (SELECT term, doc_id, regexp_matches(text, '(?im)\*\*' || term || '\*\*|^#{2,6}\s*' || term || '(?:[^\p{L}\p{N}_]|$)|' || term || '\s*[—–-]\s*це(?:[^\p{L}\p{N}_]|$)|' || term || '\s*[—–-]\s|'
  || term || '\s+is\s+|' || term || '\s+means(?:[^\p{L}\p{N}_]|$)|' || term || '\s*:\s') AS d
  FROM v JOIN documents ON contains(lower(text), lower(term))),
f AS (SELECT term, min(doc_id) AS first_doc, min(doc_id) FILTER (d) AS def_doc FROM m GROUP BY 1) """


def _keyword(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("order"), "text")
    own = c.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_BENCHMARK_TERMS), F.lit(0))).alias("term")).distinct()
    found = keyword.detect_terms(docs, (), own).where(F.col("kind") == kind)
    return found.select("term", F.col("appear").alias("first_doc"), F.col("defo").alias("def_doc"))


@query(_FIRST_SQL + "SELECT term, first_doc, def_doc FROM f WHERE first_doc < def_doc")
def benchmark_terms_used_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given terms, capitalised words of the benchmark, that documents use before one defines them."""
    return _keyword(spark, sf_dir, "used_before_introduction")


@query(_FIRST_SQL + "SELECT term, first_doc, def_doc FROM f WHERE def_doc IS NULL")
def benchmark_terms_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir, "orphan_concept")


def _whole_keyword(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("order"), "text")
    found = keyword.detect_all(docs).where(F.col("kind") == kind)
    return found.select("term", F.col("appear").alias("first_doc"), F.col("defo").alias("def_doc"))


@query()
def keyword_used_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate term of the documents themselves, tested against a plain version."""
    return _whole_keyword(spark, sf_dir, "used_before_introduction")


@query()
def keyword_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_keyword(spark, sf_dir, "orphan_concept")


# Segmentation ------------------------------------------------------------------------------


@query(f"WITH {UNITS_SQL} SELECT doc_id, unit_id, heading, length(text) AS n_chars, md5(text) AS digest FROM named")
def segment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = segment.segment(c.marked_lectures(spark, sf_dir)).select(F.col("lecture_id").cast("long").alias("doc_id"), F.explode("units").alias("u"))
    return units.select("doc_id", "u.unit_id", "u.heading", F.length("u.text").alias("n_chars"), F.md5("u.text").alias("digest"))


@query(f"WITH {UNITS_SQL} SELECT doc_id, any_value(n) AS n_units, sum(length(text))::BIGINT AS content_chars FROM named GROUP BY 1")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.manifest(segment.segment(c.marked_lectures(spark, sf_dir))).where("n_units > 0")
    return found.select(F.col("lecture_id").cast("long").alias("doc_id"), F.col("n_units").cast("long").alias("n_units"), "content_chars")


@query(f"WITH {UNITS_SQL} SELECT doc_id, unit_id FROM named WHERE ordinal = n // 2 + 1")
def middle_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.middle_unit(segment.segment(c.marked_lectures(spark, sf_dir))).select(F.col("lecture_id").cast("long").alias("doc_id"), "unit_id")


_RENDERED = """string_agg('## Unit ' || unit_id || ' — ' || heading || chr(10) || chr(10) || {text} || chr(10), chr(10) ORDER BY ordinal)"""
_HEAD = "'# Лекція ' || doc_id || ': ' || doc_id || chr(10) || '_Source: ' || doc_id || '.md_' || chr(10)"


@query(f"WITH {UNITS_SQL} SELECT doc_id, md5({_HEAD} || chr(10) || {_RENDERED.format(text='text')}) AS digest FROM named GROUP BY 1")
def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = segment.render(segment.segment(c.marked_lectures(spark, sf_dir)).where(F.size("units") > 0))
    return made.select(F.col("lecture_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


@query(f"""WITH {UNITS_SQL}, marked AS (SELECT *, CASE WHEN ordinal = n // 2 + 1 THEN CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) END || text || chr(10) || chr(10) || 'Injected sentence.' ELSE chr(10) || chr(10) || text END AS body FROM named)
SELECT doc_id, md5({_HEAD} || chr(10) || string_agg('## Unit ' || unit_id || ' — ' || heading || body || chr(10), chr(10) ORDER BY ordinal)) AS digest FROM marked GROUP BY 1""")
def inject_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence at the end of the middle unit of every document."""
    lectures = segment.segment(c.marked_lectures(spark, sf_dir)).where(F.size("units") > 0)
    targets = segment.middle_unit(lectures).select(F.lit("s").alias("spec"), "lecture_id", "unit_id", F.lit("Injected sentence.").alias("sentence"))
    made = segment.inject(segment.render(lectures), targets)
    return made.select(F.col("lecture_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


# Names -------------------------------------------------------------------------------------

_PLAIN_SQL = r"trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}_\s''-]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH f AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS name, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line, md5(array_to_string(list_filter(string_split({_PLAIN_SQL}, ' '), lambda x: x NOT IN ('', 'the', 'a', 'an', 'of')), ' ')) AS f1, md5({_PLAIN_SQL}) AS f2,
  md5(trim(regexp_replace(lower(trim(name)), '\s+', ' ', 'g'))) AS f3, md5(trim(regexp_replace(name, '\s*\([^)]*\)\s*$', ''))) AS f4 FROM f""")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a name, normalised in four ways."""
    lines = c.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "name"))
    return lines.select(
        "doc_id", (F.col("i") + 1).cast("long").alias("line"), F.md5(text.normalize_name("name")).alias("f1"), F.md5(text.plain_name("name")).alias("f2"), F.md5(text.spaced_name("name")).alias("f3"), F.md5(text.clean_name("name")).alias("f4"),
    )


@query("""WITH n AS (SELECT DISTINCT p_name AS name, list_distinct(string_split(p_name, ' ')) AS t FROM part), k AS (SELECT DISTINCT unnest(t) AS key FROM n)
SELECT key FROM k JOIN n ON list_contains(t, key) AND len(t) > 1 GROUP BY 1 HAVING count(*) >= 2""")
def ambiguous_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names that two longer names or more hold."""
    names = c.table(spark, sf_dir, "part").select(F.lit("").alias("spec"), F.col("p_name").alias("normalized")).distinct()
    keys = names.select("spec", F.explode(text.tokens(F.col("normalized"))).alias("key")).distinct()
    return resolve.ambiguous_names(names, keys).select("key")


@query("SELECT p_name AS canonical_name, count(*) AS n_occurrences, min(p_partkey) AS first_part FROM part GROUP BY 1")
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as occurrences of the concepts that their names name."""
    occs = c.table(spark, sf_dir, "part").select(
        F.lit("").alias("spec"), F.col("p_partkey").alias("occ_id"), F.col("p_name").alias("name"), text.normalize_name("p_name").alias("normalized"), F.array().cast("array<string>").alias("aliases"), F.lit("used").alias("role"),
    )
    members = resolve.cluster(occs, read_overrides(spark))
    names = resolve.canonical_names(members)
    counts = members.groupBy("cluster").agg(F.count("*").alias("n_occurrences"))
    return names.join(counts, "cluster").select("canonical_name", "n_occurrences", F.col("cluster").alias("first_part"))


# Statistics --------------------------------------------------------------------------------

_Z = 1.959963984540054


@query(f"""WITH g AS (SELECT d.source, sum(l.quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1),
w AS (SELECT *, k / n AS p, 1 + {_Z} * {_Z} / n AS width FROM g)
SELECT source, k::BIGINT AS k, n::BIGINT AS n, round(greatest(0, ((p + {_Z} * {_Z} / (2 * n)) / width) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / width), 6) AS lo,
  round(least(1, ((p + {_Z} * {_Z} / (2 * n)) / width) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / width), 6) AS hi FROM w""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good documents of each source."""
    rows = c.table(spark, sf_dir, "labels").join(c.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    counts = rows.groupBy("source").agg(F.sum("quality").cast("long").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("source", "k", "n", F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"))


@query("""WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels),
s AS (SELECT b, c, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) AS tail FROM t, range(least(b, c) + 1) r(i) GROUP BY 1, 2)
SELECT b, c, CASE WHEN tail = 0 THEN 0 ELSE round(log10(least(1, 2 * tail)), 4) END AS log_p FROM s""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discordant pairs of the two labels, and the power of ten of their p."""
    t = c.table(spark, sf_dir, "labels").agg(
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("c")
    )
    p = stats.mcnemar_exact(F.col("b"), F.col("c"))
    return t.select("b", "c", F.when(p == 0, 0.0).otherwise(F.round(F.log10(p), 4)).alias("log_p"))


@query("""WITH g AS (SELECT d.source, count(*) FILTER (quality = 0 AND toxic = 0) AS a, count(*) FILTER (quality = 0 AND toxic = 1) AS b, count(*) FILTER (quality = 1 AND toxic = 0) AS c,
  count(*) FILTER (quality = 1 AND toxic = 1) AS d FROM labels l JOIN documents d USING (doc_id) GROUP BY 1),
p AS (SELECT source, a, x, lgamma(a+b+1) - lgamma(x+1) - lgamma(a+b-x+1) + lgamma(c+d+1) - lgamma(a+c-x+1) - lgamma(d-a+x+1) - (lgamma(a+b+c+d+1) - lgamma(a+c+1) - lgamma(b+d+1)) AS lp
  FROM g, range(0, 100000) r(x) WHERE x >= greatest(0, a - d) AND x <= least(a + b, a + c))
SELECT q.source, round(least(1, sum(exp(q.lp))), 6) AS p FROM p q JOIN p o ON o.source = q.source AND o.x = o.a WHERE q.lp <= o.lp + 1e-9 GROUP BY 1""")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether good and toxic labels hang together, by source."""
    rows = c.table(spark, sf_dir, "labels").join(c.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    cells = [F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(n) for n, q, t in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))]
    counts = rows.groupBy("source").agg(*cells)
    return counts.select("source", F.round(stats.fisher_exact(*[F.col(n) for n in "abcd"]), 6).alias("p"))


@query("""SELECT lang, count(*) FILTER (quality = 1) AS quality, count(*) FILTER (toxic = 1) AS toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def method_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "labels").join(c.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.tally(rows.select("lang", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic")), ["quality", "toxic"], ["lang"])


@query("""WITH r AS (SELECT lang, quality = 1 AS hit, ['blatant', 'medium', 'subtle'][(doc_id % 3 + 1)::INT] AS t FROM labels JOIN documents USING (doc_id))
SELECT lang, count(*) FILTER (hit AND t = 'blatant') AS blatant_hits, count(*) FILTER (t = 'blatant') AS blatant_n, count(*) FILTER (hit AND t = 'medium') AS medium_hits, count(*) FILTER (t = 'medium') AS medium_n,
  count(*) FILTER (hit AND t = 'subtle') AS subtle_hits, count(*) FILTER (t = 'subtle') AS subtle_n, count(*) FILTER (hit) AS hits, count(*) AS n FROM r GROUP BY 1""")
def recall_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "labels").join(c.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.recall(rows.select("lang", (F.col("quality") == 1).alias("detected"), text.tier(F.col("doc_id")).alias("subtlety")), kind="lang")


@query("""WITH g AS (SELECT lang, source, count(*) AS flagged, count(*) FILTER (quality = 1) AS confirmed FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, round(avg(confirmed / flagged), 6) AS macro, round(sum(confirmed) / sum(flagged), 6) AS micro, sum(confirmed)::BIGINT AS confirmed, sum(flagged)::BIGINT AS flagged FROM g GROUP BY 1""")
def macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "labels").join(c.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    rates = rows.groupBy("lang", "source").agg(F.count("*").alias("flagged"), F.count_if(F.col("quality") == 1).alias("confirmed"))
    found = evaluate.averages(rates, ["lang"], "confirmed", "flagged")
    return found.select("lang", F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"), "confirmed", "flagged")


# Rules and sequences -----------------------------------------------------------------------


@query("""SELECT 'duplicate_text' AS rule, (SELECT count(*) - count(DISTINCT text) FROM documents) AS n UNION ALL
SELECT 'wrong_length', (SELECT count(*) FROM documents WHERE n_chars <> length(text)) UNION ALL
SELECT 'label_without_document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL
SELECT 'repeated_line', (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem) UNION ALL
SELECT 'unknown_role', (SELECT count(*) FROM conversations WHERE role NOT IN ('assistant', 'user'))""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lines = c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "lineitem")
    rules = {
        "duplicate_text": quality.repeated(docs.withColumn("key", F.sha2("text", 256)).select("doc_id", "key"), ["key"], ["doc_id"]),
        "wrong_length": docs.where(F.col("n_chars") != F.length("text")),
        "label_without_document": quality.missing_keys(c.table(spark, sf_dir, "labels"), "doc_id", docs, "doc_id"),
        "repeated_line": quality.repeated(lines.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], ["l_orderkey"]),
        "unknown_role": c.table(spark, sf_dir, "conversations").where(~F.col("role").isin("assistant", "user")),
    }
    found = None
    for rule, rows in rules.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        found = n if found is None else found.unionByName(n)
    return found


@query("""WITH t AS (SELECT user_id, min((ts, event_id)) FILTER (event_type = 'view') AS intro, min((ts, event_id)) FILTER (event_type = 'click') AS used FROM events GROUP BY 1)
SELECT t.user_id, t.used[2] AS used_event, t.intro[2] AS intro_event, count(*) AS n_used_before FROM t JOIN events e ON e.user_id = t.user_id AND e.event_type = 'click' AND (e.ts, e.event_id) < t.intro WHERE t.used < t.intro GROUP BY ALL""")
def click_before_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who click before they first view."""
    events, kind = c.table(spark, sf_dir, "events"), F.col("event_type")
    found = detect.earliest_before(events, ["user_id"], F.struct("ts", "event_id"), kind == "view", kind == "click")
    return found.select("user_id", F.col("used_at.event_id").alias("used_event"), F.col("intro.event_id").alias("intro_event"), "n_used_before")


# Smaller pieces ----------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\*\*([^*\n]{3,60})\*\*', 1)) AS raw FROM documents)
SELECT trim(raw) AS term, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY 1""")
def bold_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans between double stars and the documents that hold them."""
    docs = c.table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(keyword.BOLD), F.lit(1))).alias("raw"))
    return found.groupBy(text.strip("raw").alias("term")).agg(F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {STATED_SQL} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM stated) AS n_stated")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = c.stated_edges(spark, sf_dir)
    return graph.counts(stated.select("src", "dst").distinct()).join(stated.agg(F.count("*").alias("n_stated")))


@query("""WITH g AS (SELECT p_name AS name, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS aliases FROM part GROUP BY 1) SELECT '- ' || name || ' (' || aliases || ')' AS line FROM g""")
def vocabulary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with their brands as aliases, as lines of a vocabulary."""
    rows = c.table(spark, sf_dir, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    return rows.select(text.vocabulary_line(F.col("p_name"), F.col("aliases")).alias("line"))


@query(f"""WITH g AS (SELECT d.lang, sum(l.quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1),
w AS (SELECT *, k / n AS p, 1 + {_Z} * {_Z} / n AS width FROM g)
SELECT lang, printf('%d/%d = %.3f, 95%% Wilson CI %.3f-%.3f', k::BIGINT, n::BIGINT, p, greatest(0, ((p + {_Z} * {_Z} / (2 * n)) / width) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / width),
  least(1, ((p + {_Z} * {_Z} / (2 * n)) / width) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / width)) AS line FROM w""")
def described_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "labels").join(c.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    counts = rows.groupBy("lang").agg(F.sum("quality").cast("long").alias("k"), F.count("*").alias("n"))
    return counts.select("lang", stats.describe(F.col("k"), F.col("n")).alias("line"))


@query("""WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r, lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, role, before FROM s WHERE r > 1""")
def repeated_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns after the first of a role in their conversation, with the turn before."""
    rows = c.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return quality.repeated(rows, ["conv_id", "role"], ["turn"])


@query("""SELECT o_orderstatus AS lecture, o_orderpriority AS concept, count(DISTINCT o_custkey) AS votes, arg_min(o_orderkey, (o_custkey, o_orderkey)) AS representative FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_custkey) >= 3""")
def vote_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of customers, as runs, for the priority of an order, as an edge; the first stands for all."""
    orders = c.table(spark, sf_dir, "orders")
    edge = F.array(F.struct(F.col("o_orderpriority").alias("from"), F.lit("x").alias("to"), F.col("o_orderkey").cast("string").alias("reason"), F.lit("").alias("evidence_unit")))
    runs = orders.groupBy("o_orderstatus", "o_custkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", edge.alias("e")))), lambda x: x["e"])).alias("prerequisites"))
    runs = runs.select(F.col("o_orderstatus").alias("lecture_id"), F.col("o_custkey").alias("run"), "prerequisites")
    return vote_edges(runs, 3).select(F.col("lecture_id").alias("lecture"), F.col("from").alias("concept"), "votes", F.col("reason").cast("long").alias("representative"))


# The whole chain, from extractions to detectors ----------------------------------------------


def _conversation_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes of conversations as lectures, whose turns are units and whose words are
    extracted concepts."""
    occ = c.occurrences(spark, sf_dir)
    role = F.when(c.introduced(), "introduced").otherwise("used")
    unit = F.format_string("%02d#%02d", F.col("conv_id"), F.col("turn"))
    concept = F.struct(
        F.col("concept").alias("name"), F.array().cast("array<string>").alias("aliases"), F.when(c.introduced(), "d").otherwise("").alias("definition"), unit.alias("first_mentioned_unit"), role.alias("role"),
    )
    lectures = occ.groupBy("conv_id").agg(F.collect_list(concept).alias("concepts"))
    none = F.array().cast("array<struct<`from`:string,`to`:string,reason:string,evidence_unit:string>>")
    extractions = lectures.select(F.lit(evaluate.CLEAN).alias("spec"), F.col("conv_id").cast("string").alias("lecture_id"), "concepts", none.alias("prerequisites"), F.col("conv_id").alias("pos"))
    manifest = c.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("lecture_id"), F.col("conv_id").cast("int").alias("lecture_order")).distinct()
    return build_nodes(resolve.resolve(extractions, manifest, read_overrides(spark)).concepts)


@query(f"""WITH {OCC_SQL},
t AS (SELECT concept, min((conv_id, turn)) FILTER (role = 'assistant') AS intro, min((conv_id, turn)) FILTER (role = 'user') AS used FROM occ GROUP BY 1)
SELECT t.concept, t.used[1] AS used_conv, t.intro[1] AS intro_conv, count(*) AS n_used_before
FROM t JOIN occ o ON o.concept = t.concept AND o.role = 'user' AND (o.conv_id, o.turn) < t.intro WHERE t.used < t.intro GROUP BY ALL""")
def course_used_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.used_before_introduction(_conversation_course(spark, sf_dir))
    return found.select("concept", F.col("used_lecture").cast("long").alias("used_conv"), F.col("introduced_lecture").cast("long").alias("intro_conv"), F.col("n_used_before").cast("long").alias("n_used_before"))


@query(f"WITH {OCC_SQL} SELECT concept, count(*) AS n_used, min((conv_id, turn))[1] AS first_conv FROM occ GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') = 0 AND count(*) FILTER (role = 'user') > 0")
def course_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.orphan_concepts(_conversation_course(spark, sf_dir))
    return found.select("concept", F.col("n_used").cast("long").alias("n_used"), F.col("first_used_lecture").cast("long").alias("first_conv"))


@query(f"""WITH {OCC_SQL} SELECT concept, count(*) AS definition_count, count(DISTINCT conv_id) AS lecture_count FROM occ WHERE role = 'assistant' GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT conv_id) >= 2""")
def course_definition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.definition_conflicts(_conversation_course(spark, sf_dir))
    return found.select("concept", F.col("definition_count").cast("long").alias("definition_count"), F.col("lecture_count").cast("long").alias("lecture_count"))
