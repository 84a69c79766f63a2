"""Round trips: what writers write, readers read again, against SQL over the tables themselves."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import number
from lectern.operators import segment
from lectern.plans import trade
from lectern.plans.brand_queries import SECTIONS_SQL, markdown
from lectern.plans.course import table
from lectern.plans.registry import query
from lectern.plans.trade import CONCEPTS_SQL, EDGES_SQL, LINES_SQL, MEMBERS_SQL, NODES_SQL
from lectern.session import saved, shared_folder
from lectern.sources import course, sinks


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files/{uuid4().hex}"


@query(f"WITH {SECTIONS_SQL} SELECT lecture_id || '.md' AS file_name, lecture_id, b AS lecture_order, md5(text) AS digest FROM md")
def file_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files of a folder; one without a number in its name is left out."""
    path, rows = folder(spark), markdown(spark, sf_dir).select("file_name", "text")
    sinks.write_files(rows.union(spark.createDataFrame([("readme.md", "x")], rows.schema)), path, "file_name", "text")
    return course.read_markdown(spark, path).select("file_name", "lecture_id", "lecture_order", F.md5("text").alias("digest"))


@query(f"WITH {SECTIONS_SQL} SELECT lecture_id AS lecture, unit_id AS unit, heading, md5(text) AS digest FROM named")
def file_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmented lectures, written one by one and looked up by unit."""
    path = folder(spark)
    sinks.write_lectures(segment.segment(markdown(spark, sf_dir)), path)
    return course.unit_texts(course.read_lectures(spark, path)).select("lecture", "unit", "heading", F.md5("text").alias("digest"))


@query(f"WITH {SECTIONS_SQL} SELECT lecture_id, md5(lower(string_agg(text, ' ' ORDER BY ordinal))) AS digest FROM named GROUP BY 1")
def file_lecture_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lectures in lower case; a file without an id is named by its stem."""
    path = folder(spark)
    lectures = segment.segment(markdown(spark, sf_dir)).withColumn("file", F.concat("lecture_id", F.lit(".json")))
    sinks.write_files(lectures.select("file", F.to_json(F.struct("title", "units")).alias("t")), path, "file", "t")
    return course.lecture_texts(course.read_lectures(spark, path)).select("lecture_id", F.md5("lower").alias("digest"))


@query(f"""WITH {SECTIONS_SQL} SELECT lecture_id, b AS lecture_order, count(*)::INT AS n_units, (count(*) FILTER (kind = 'content'))::INT AS n_content_units FROM named GROUP BY 1, 2""")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest; of a lecture listed twice the last row counts."""
    path = folder(spark)
    own = segment.manifest(segment.segment(markdown(spark, sf_dir)))
    sinks.write_manifest(own.withColumn("n_units", F.lit(0)).unionByName(own), path)
    return course.read_manifest(spark, f"{path}/*.json").select("lecture_id", "lecture_order", "n_units", "n_content_units")


@query(f"""WITH {SECTIONS_SQL} SELECT md5('# Лекція ' || b || ': ' || CASE WHEN b % 5 = 0 THEN lecture_id ELSE 'Brand ' || b END || chr(10) || '_Source: ' || lecture_id || '.md_' || chr(10) || chr(10) ||
  string_agg('## Unit ' || unit_id || ' — ' || heading || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY ordinal)) AS digest, lecture_id FROM named WHERE kind = 'content' GROUP BY b, lecture_id""")
def file_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered lectures, as files by their lecture."""
    path = folder(spark)
    sinks.write_rendered(segment.render(segment.segment(markdown(spark, sf_dir))).withColumn("text", F.concat("text", F.lit("|end"))), path)
    read = spark.read.text(path, wholetext=True)
    return read.select(F.md5(F.regexp_replace("value", r"\|end\n\z", "")).alias("digest"), "lecture_id")


@query(f"""WITH {LINES_SQL} SELECT lecture AS lecture_id, count(*) AS n_concepts, count(role) AS n_roles, md5(string_agg(name, '|' ORDER BY i)) AS names FROM li GROUP BY 1""")
def file_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions by file; of a lecture's files the last one counts, and one without an id is skipped."""
    path = folder(spark)
    rows = trade.extractions(spark, sf_dir).drop("spec", "pos")
    # Months are brought together once for both folders.
    last = saved(rows.select(F.concat("lecture_id", F.lit(".b.json")).alias("f"), F.to_json(F.struct(*rows.columns)).alias("t"), "lecture_id"))
    last, ids = last.select("f", "t"), last.select("lecture_id")
    first = ids.select(F.concat("lecture_id", F.lit(".a.json")).alias("f"), F.to_json(F.struct("lecture_id", F.array().cast("array<string>").alias("concepts"))).alias("t"))
    sinks.write_files(last.union(first), path, "f", "t")
    found = course.keyed_extractions(spark, path)
    plain = folder(spark)
    sinks.write_files(last.union(spark.createDataFrame([("none.json", '{"concepts": []}')], "f string, t string")), plain, "f", "t")
    kept = course.read_extractions(spark, plain).select("lecture_id")
    names = F.array_join(F.transform("concepts", lambda c: c["name"]), "|")
    roles = F.size(F.filter("concepts", lambda c: c["role"].isNotNull()))
    return found.join(kept, "lecture_id").select("lecture_id", F.size("concepts").cast("long").alias("n_concepts"), roles.cast("long").alias("n_roles"), F.md5(names).alias("names"))


@query(f"""WITH {LINES_SQL} SELECT 'inj-' || lecture AS spec, lecture AS lecture_id, count(*) AS n FROM li GROUP BY 1, 2""")
def file_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions of variants, each in a folder of its name."""
    path = folder(spark)
    rows = trade.extractions(spark, sf_dir)
    sinks.write_files(rows.select(F.concat(F.lit("inj-"), "lecture_id", F.lit("/extraction.json")).alias("f"), F.to_json(F.struct("lecture_id", "concepts")).alias("t")), path, "f", "t")
    return course.read_injected(spark, f"{path}/*/extraction.json").select("spec", "lecture_id", F.size("concepts").cast("long").alias("n"))


@query("""WITH e AS (SELECT DISTINCT p_brand, (p_size % 5 + 1)::INT AS run, p_type AS f, p_name AS t FROM part), l AS (SELECT 'lecture' || regexp_extract(p_brand, '([0-9]+)', 1) AS lecture_id, * FROM e)
SELECT lecture_id, run, count(*)::INT AS n_edges FROM l GROUP BY 1, 2""")
def file_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs by lecture; absent and unreadable ones are left out."""
    path = folder(spark)
    edge = F.struct(F.col("p_type").alias("from"), F.col("p_name").alias("to"), F.lit("r").alias("reason"), F.lit("").alias("evidence_unit"))
    key = F.concat(F.lit("lecture"), F.regexp_extract("p_brand", "([0-9]+)", 1))
    runs = table(spark, sf_dir, "part").groupBy(key.alias("lecture_id"), (F.col("p_size") % 5 + 1).alias("run")).agg(F.array_sort(F.collect_set(edge)).alias("prerequisites"))
    files = runs.select(F.concat("lecture_id", F.lit(".prereq.run"), "run", F.lit(".json")).alias("f"), F.to_json(F.struct("lecture_id", "prerequisites")).alias("t"))
    broken = runs.select(F.concat("lecture_id", F.lit(".prereq.run9.json")).alias("f"), F.lit('{"lecture_id": "x", "prereq').alias("t")).distinct()
    sinks.write_files(files.union(broken), path, "f", "t")
    return course.read_runs(spark, f"{path}/*.json").select("lecture_id", "run", F.size("prerequisites").alias("n_edges"))


@query("""SELECT 'split' AS kind, p_name || ' 1' AS a, p_brand || ' 1' AS b FROM part WHERE p_type = 'STANDARD' AND p_size = 1 UNION SELECT 'merge', p_name || ' 2', p_name || ' 3' FROM part WHERE p_type = 'MEDIUM' AND p_size = 2
UNION SELECT 'exclude', p_name || ' 4', NULL FROM part WHERE p_type = 'SMALL' AND p_size = 4""")
def file_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides, replaced in place and read again; a path without a file gives none."""
    path = folder(spark)
    sinks.write_overrides(course.read_overrides(spark, f"{path}/none.json"), path)
    sinks.write_overrides(trade.overrides(spark, sf_dir), path)
    rows = course.read_overrides(spark, path)
    groups = [rows.select(F.lit(k).alias("kind"), F.explode(f"{k}_groups").alias("g")).select("kind", F.col("g")[0].alias("a"), F.col("g")[1].alias("b")) for k in ("split", "merge")]
    return groups[0].union(groups[1]).union(rows.select(F.lit("exclude"), F.explode("exclude"), F.lit(None).cast("string")))


@query(f"""WITH RECURSIVE {CONCEPTS_SQL + NODES_SQL} SELECT canonical AS name, n_introduced::INT AS n_introduced, n_used::INT AS n_used, intro[1] AS lecture_introduced, intro[3] AS intro_order, intro[4] AS intro_unit, first_used[3] AS used_order, n_defs::INT AS n_defs, n_seen::INT AS n_seen FROM nodes""")
def file_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a graph, through one node-link document."""
    path = folder(spark)
    sinks.write_json(sinks.node_link(*trade.graph(spark, sf_dir)), path)
    nodes, _ = course.read_graph(spark, f"{path}/*.json")
    return nodes.select(
        "name", "n_introduced", "n_used", "lecture_introduced", F.col("order_introduced.lec").alias("intro_order"), F.col("order_introduced.unit").alias("intro_unit"), F.col("order_first_used.lec").alias("used_order"), F.size("definitions").alias("n_defs"), number(F.col("appearances")).cast("int").alias("n_seen"),
    )


@query(f"WITH RECURSIVE {EDGES_SQL} SELECT src, dst, reason, evidence_lecture, evidence_unit FROM edges")
def file_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a graph, through one node-link document."""
    path = folder(spark)
    sinks.write_json(sinks.node_link(*trade.graph(spark, sf_dir)), path)
    return course.read_graph(spark, f"{path}/*.json")[1]


@query(f"""WITH RECURSIVE {MEMBERS_SQL}, e AS (SELECT '<node id="' || canonical || '">' AS line FROM canon) SELECT count(*) AS n_nodes, md5(string_agg(line, '' ORDER BY line)) AS digest FROM e""")
def file_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a GraphML file, by its lines."""
    path = folder(spark)
    nodes, edges = trade.graph(spark, sf_dir)
    sinks.write_graphml(nodes, edges, path)
    line = F.regexp_extract("value", '^(<node id="[^"]*">)', 1)
    rows = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    return rows.agg(F.count("*").alias("n_nodes"), F.md5(F.array_join(F.array_sort(F.collect_list("line")), "")).alias("digest"))


@query(f"""WITH RECURSIVE {CONCEPTS_SQL}, l AS (SELECT '- ' || canonical || CASE WHEN aliases = '' THEN '' ELSE ' (' || replace(aliases, '|', ', ') || ')' END AS value, place FROM with_aliases) SELECT md5(string_agg(value, chr(10) ORDER BY place)) AS digest, count(*) AS n FROM l""")
def file_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary file, its lines in their order."""
    path = folder(spark)
    sinks.write_vocabulary(trade.graph(spark, sf_dir)[0], path)
    whole = spark.read.text(path, wholetext=True).where("value <> ''")
    lines = F.regexp_replace("value", r"\n\z", "")
    return whole.select(F.md5(lines).alias("digest"), F.size(F.split(lines, "\n")).cast("long").alias("n"))


@query(f"""WITH RECURSIVE {CONCEPTS_SQL} SELECT 'orphan_concepts' AS kind, count(*) AS n FROM concepts WHERE n_introduced = 0 AND n_used > 0 UNION ALL SELECT 'definition_conflicts', count(*) FROM concepts WHERE n_defs >= 2 AND n_def_lectures >= 2""")
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's tables, counted as they stand in its files."""
    from lectern.operators import detect

    path = folder(spark)
    nodes, _ = trade.graph(spark, sf_dir)
    sinks.write_report({"orphan_concepts": detect.orphan_concepts(nodes), "definition_conflicts": detect.definition_conflicts(nodes)}, path)
    parts = [spark.read.text(f"{path}/{k}").agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("orphan_concepts", "definition_conflicts")]
    return parts[0].union(parts[1])


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_name AS id, 'region ' || n_regionkey AS target FROM nation")
def file_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs of one array, in their order."""
    path = folder(spark)
    rows = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("id"), F.concat(F.lit("region "), "n_regionkey").alias("target")))).alias("a"))
    sinks.write_files(rows.select(F.lit("specs.json").alias("f"), F.to_json("a").alias("t")), path, "f", "t")
    return course.read_specs(spark, f"{path}/specs.json", "id string, target string").select("k", "id", "target")


@query("SELECT n_name AS id, ['a', n_name] AS used_before, NULL::VARCHAR[] AS orphans FROM nation WHERE n_regionkey < 3")
def file_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional outputs by injection: what has no file has no row."""
    path = folder(spark)
    rows = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    sinks.write_files(rows.select(F.concat("n_name", F.lit("/direct.json")).alias("f"), F.to_json(F.struct(F.array(F.lit("a"), "n_name").alias("used_before"))).alias("t")), path, "f", "t")
    none = course.read_direct(spark, f"{path}/*/missing.json", "used_before array<string>, orphans array<string>")
    return none.unionByName(course.read_direct(spark, f"{path}/*/direct.json", "used_before array<string>, orphans array<string>"))


@query("""SELECT lang AS course, 'temporal_graph' AS method, 'q' AS defect, (count(*) FILTER (quality = 1))::INT AS hits, 9 AS trials FROM labels JOIN documents USING (doc_id) GROUP BY 1
UNION ALL SELECT lang, 'direct_model', 'q', (count(*) FILTER (toxic = 0))::INT, 9 FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested counts by method, course and defect."""
    path = folder(spark)
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    by = rows.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("g"), F.count_if(F.col("toxic") == 0).alias("d"), F.count("*").alias("n"))
    cells = [F.map_from_entries(F.collect_list(F.struct("lang", F.create_map(F.lit("q"), x)))).alias(m) for m, x in (("temporal_graph", "g"), ("direct_model", "d"))]
    rates = [F.map_from_entries(F.collect_list(F.struct("lang", F.struct(F.col("n").alias("flagged"), F.col(x).alias("confirmed"))))).alias(f"{m}_rate") for m, x in (("temporal_graph", "g"), ("direct_model", "d"))]
    whole = by.agg(*cells, *rates)
    recall = F.struct(F.lit(9).alias("injections_per_course_and_type"), "temporal_graph", "direct_model", F.create_map(F.lit("both_identified"), F.lit(1)).alias("paired"))
    precision = F.struct(F.col("temporal_graph_rate").alias("temporal_graph"), F.col("direct_model_rate").alias("direct_model"))
    sinks.write_files(whole.select(F.lit("counts.json").alias("f"), F.to_json(F.struct(recall.alias("recall"), precision.alias("precision"))).alias("t")), path, "f", "t")
    return course.read_counts(spark, f"{path}/counts.json")[0].select("course", "method", "defect", "hits", "trials")


@query("SELECT 'd' || n_regionkey AS dataset, 'id' AS id, arg_max(n_name, n_nationkey) AS sentence FROM nation GROUP BY 1")
def file_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored sentences; the last of equal keys counts."""
    path = folder(spark)
    one = F.struct("n_nationkey", F.concat(F.lit("d"), "n_regionkey").alias("dataset"), F.lit("id").alias("id"), F.col("n_name").alias("sentence"))
    rows = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(one)).alias("a"))
    sinks.write_files(rows.select(F.lit("sentences.json").alias("f"), F.to_json("a").alias("t")), path, "f", "t")
    return course.read_sentences(spark, f"{path}/sentences.json")


@query("""WITH s AS (SELECT r_name AS spec, r_regionkey AS k FROM region)
SELECT spec, md5(string_agg(CASE WHEN n_nationkey = k THEN 'new ' || spec ELSE n_name END, chr(10) || chr(10) ORDER BY n_nationkey, n_nationkey::VARCHAR)) AS digest FROM nation CROSS JOIN s GROUP BY 1""")
def file_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole courses, each with one lecture replaced, as files by variant."""
    path = folder(spark)
    clean = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("lecture_order"), F.col("n_nationkey").cast("string").alias("lecture_id"), F.col("n_name").alias("text"))
    overlay = table(spark, sf_dir, "region").select(F.col("r_name").alias("spec"), F.col("r_regionkey").cast("string").alias("lecture_id"), F.concat(F.lit("new "), "r_name").alias("text"))
    sinks.write_course(course.with_overlay(clean, overlay), path)
    return spark.read.text(path, wholetext=True).select("spec", F.md5(F.regexp_replace("value", r"\n\z", "")).alias("digest"))


@query("SELECT 'v' || r_regionkey AS spec, 'l' || r_regionkey AS lecture_id, CASE WHEN r_regionkey = 0 THEN 'again ' ELSE 'first ' END || r_name AS text FROM region")
def file_injected_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected lectures by variant: variants written again replace their files, others stay."""
    path = folder(spark)
    rows = table(spark, sf_dir, "region").select(F.concat(F.lit("v"), "r_regionkey").alias("spec"), F.concat(F.lit("l"), "r_regionkey").alias("lecture_id"), F.concat(F.lit("first "), "r_name").alias("text"))
    sinks.write_injected(rows, path)
    sinks.write_injected(rows.where("spec = 'v0'").withColumn("text", F.regexp_replace("text", "^first", "again")), path)
    return spark.read.text(path, wholetext=True).select("spec", "lecture_id", F.regexp_replace("value", r"\n\z", "").alias("text"))
