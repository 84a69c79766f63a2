"""The driver's tables as courses: the column mappings that the catalogue shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a concept in conversations.
TOKEN = "[a-zà-ÿ]{4,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt to all cores where fewer tasks would read them: few files of long texts."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concept, conv_id, turn, role: the distinct words of each turn that isn't the system's."""
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))
    return rows.select("conv_id", "turn", "role", F.explode(found).alias("concept"))


def at() -> Column:
    return F.struct("conv_id", "turn")


def introduced() -> Column:
    return F.col("role") == "assistant"


def used() -> Column:
    return F.col("role") == "user"


def stated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, l_orderkey, l_linenumber, date: the supplier of every line, and that of the
    next line of its order."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("src"), F.col("l_shipdate").alias("date"))
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated_edges(spark, sf_dir).select("src", "dst").distinct()


def introductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, at: when each supplier first ships."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.min("l_shipdate").alias("at"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, vec_id, lecture, embedding: vectors as definitions of their label."""
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") % 10).alias("lecture"), "embedding")


def marked_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lecture_id, lecture_order, file_name, text: documents as lectures, in which a line that
    ends in a full stop heads a section."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(x.endswith("."), F.concat(F.lit("## "), x)).otherwise(x))
    key = F.col("doc_id").cast("string")
    return docs.select(key.alias("lecture_id"), F.col("doc_id").cast("int").alias("lecture_order"), F.concat(key, F.lit(".md")).alias("file_name"), F.array_join(lines, "\n").alias("text"))


#: SQL of the mappings above.
OCC_SQL = f"""occ AS (
  SELECT DISTINCT conv_id, turn, role, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS concept
  FROM conversations WHERE role <> 'system')"""
STATED_SQL = """stated AS MATERIALIZED (
  SELECT a.l_suppkey AS src, b.l_suppkey AS dst, a.l_orderkey, a.l_linenumber, a.l_shipdate AS date
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_suppkey <> b.l_suppkey),
edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM stated),
intro AS (SELECT l_suppkey AS node, min(l_shipdate) AS at FROM lineitem GROUP BY 1)"""
UNITS_SQL = """l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, line LIKE '%.' AS head FROM l),
s AS (
  SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS section, max(CASE WHEN NOT head AND trim(line) <> '' THEN 1 ELSE 0 END) OVER w AS begun
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (
  SELECT doc_id, section, coalesce(max(CASE WHEN head THEN trim(line) END), '(преамбула)') AS heading,
    coalesce(regexp_replace(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g'), '') AS text
  FROM s WHERE head OR section > 0 OR begun = 1 GROUP BY 1, 2),
units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS ordinal, count(*) OVER (PARTITION BY doc_id) AS n FROM u),
named AS (SELECT *, printf('%02d#%02d', doc_id, ordinal) AS unit_id FROM units)"""
