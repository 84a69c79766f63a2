"""Readers of course artifacts; all go through Spark, so paths may be in any store it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import lecture_number

UNIT = "struct<heading:string,kind:string,text:string,unit_id:string,`order`:int>"
LECTURE = f"lecture_id string, lecture_order int, title string, source_file string, units array<{UNIT}>"
MANIFEST = "lecture_id string, lecture_order int, title string, n_units int, n_content_units int, content_chars long"
CONCEPT = "struct<name:string,aliases:array<string>,definition:string,first_mentioned_unit:string,role:string>"
EDGE = "struct<`from`:string,`to`:string,reason:string,evidence_unit:string>"
EXTRACTION = f"lecture_id string, concepts array<{CONCEPT}>, prerequisites array<{EDGE}>"
OVERRIDES = "split_groups array<array<string>>, merge_groups array<array<string>>, exclude array<string>"
NODE = (
    "struct<id:string,canonical_name:string,aliases:array<string>,definitions:array<struct<text:string,lecture:string,unit:string>>,"
    "appearances:array<struct<lecture:string,lecture_order:int,unit:string,role:string,n:long,forward_ref:boolean>>,roles:map<string,int>,"
    "n_introduced:int,n_used:int,lecture_introduced:string,unit_introduced:string,order_introduced:array<int>,"
    "lecture_first_used:string,unit_first_used:string,order_first_used:array<int>>"
)
LINK = "struct<source:string,target:string,reason:string,evidence_lecture:string,evidence_unit:string>"
GRAPH = f"nodes array<{NODE}>, edges array<{LINK}>"


def _name() -> Column:
    return F.col("_metadata.file_name")


def _stem() -> Column:
    return F.regexp_replace(_name(), r"\.[^.]*\z", "")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents; a path without files gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema + ", file_name string, stem string")
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    return read.withColumns({"file_name": _name(), "stem": _stem()})


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """file_name, lecture_id (the stem), lecture_order, text; stems without a number are left out."""
    read = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    named = read.select(_name().alias("file_name"), _stem().alias("lecture_id"), F.col("value").alias("text"))
    return named.withColumn("lecture_order", lecture_number(F.col("lecture_id"))).where("lecture_order is not null").orderBy("file_name")


def read_pdf(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """file_name, stem, text of PDF files: the text of their pages, end to end.

    extract: a function from a file's bytes to text, pypdf's by default (an optional library).
    """
    if extract is None:
        import io

        from pypdf import PdfReader

        def extract(content: bytes) -> str:
            return "".join(page.extract_text() for page in PdfReader(io.BytesIO(content)).pages)

    def run(frames):
        for frame in frames:
            yield frame.assign(text=[extract(bytes(c)) for c in frame["content"]])[["file_name", "stem", "text"]]

    files = spark.read.format("binaryFile").load(path).select(_name().alias("file_name"), _stem().alias("stem"), "content")
    return files.mapInPandas(run, "file_name string, stem string, text string")


def read_lectures(spark: SparkSession, path: str) -> DataFrame:
    """Segmented lectures; a lecture_id that a file lacks is its stem."""
    return _json(spark, path, LECTURE).withColumn("lecture_id", F.coalesce("lecture_id", "stem"))


def unit_texts(lectures: DataFrame) -> DataFrame:
    """lecture, unit, heading, text: one row a unit; the last of equal ids counts."""
    rows = lectures.select("lecture_id", F.posexplode("units").alias("i", "u"))
    return rows.groupBy(F.col("lecture_id").alias("lecture"), F.col("u.unit_id").alias("unit")).agg(
        F.max_by("u.heading", "i").alias("heading"), F.max_by("u.text", "i").alias("text")
    )


def lecture_texts(lectures: DataFrame) -> DataFrame:
    """lecture_id, lower: the lower-case texts of all units with a space between."""
    return lectures.select("lecture_id", F.lower(F.array_join(F.transform("units", lambda u: u["text"]), " ")).alias("lower"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """lecture_id, lecture_order and counts; of an id listed twice the last row counts."""
    rows = _json(spark, path, MANIFEST).withColumn("i", F.monotonically_increasing_id())
    own = [c for c in rows.columns if c not in ("lecture_id", "i", "file_name", "stem")]
    return rows.groupBy("lecture_id").agg(*[F.max_by(c, "i").alias(c) for c in own])


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extractions in file order (pos); files without a lecture_id are skipped."""
    return _json(spark, path, EXTRACTION).where("lecture_id is not null").withColumn("pos", F.col("file_name")).drop("stem")


def keyed_extractions(spark: SparkSession, path: str) -> DataFrame:
    """One extraction a lecture: the last file's content at the first one's place; a file
    without lecture_id is an error."""
    rows = _json(spark, path, EXTRACTION)
    key = F.when(F.col("lecture_id").isNull(), F.raise_error(F.concat(F.lit("no lecture_id in "), "file_name")).cast("string")).otherwise(F.col("lecture_id"))
    rows = rows.withColumn("lecture_id", key)
    return rows.groupBy("lecture_id").agg(
        F.max_by("concepts", "file_name").alias("concepts"), F.max_by("prerequisites", "file_name").alias("prerequisites"), F.min("file_name").alias("pos")
    )


def read_injected(spark: SparkSession, path: str) -> DataFrame:
    """spec, lecture_id, concepts, prerequisites: extractions in folders named by their spec."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"spec string, {EXTRACTION}")
    read = spark.read.schema(EXTRACTION).option("multiLine", True).json(path)
    return read.select(_folder().alias("spec"), "lecture_id", "concepts", "prerequisites")


def _folder() -> Column:
    return F.element_at(F.split("_metadata.file_path", "/"), -2)


def read_runs(spark: SparkSession, path: str, with_folder: bool = False) -> DataFrame:
    """lecture_id, run, prerequisites of repeated edge runs; unreadable files are left out.

    Files are named <lecture>.<kind>.run<k>.json; k is the run. with_folder: also spec, the
    name of a file's folder.
    """
    folder = ["spec"] if with_folder else []
    if not _exists(spark, path):
        return spark.createDataFrame([], ", ".join([*[f"{c} string" for c in folder], f"lecture_id string, run int, prerequisites array<{EDGE}>"]))
    schema = f"lecture_id string, prerequisites array<{EDGE}>, _corrupt_record string"
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = read.withColumns({"run": F.regexp_extract(_name(), r"run([0-9]+)\.json\z", 1).try_cast("int"), "first": F.regexp_extract(_name(), r"^(.*?)\.", 1), "spec": _folder()})
    return rows.where("_corrupt_record is null and run is not null").select(
        *folder, F.coalesce("lecture_id", "first").alias("lecture_id"), "run", F.coalesce("prerequisites", F.array().cast(f"array<{EDGE}>")).alias("prerequisites")
    )


def read_overrides(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row of split groups, merge groups and excluded names; empty without a file."""
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([([], [], [])], OVERRIDES)
    read = spark.read.schema(OVERRIDES).option("multiLine", True).json(path)
    groups = F.array().cast("array<array<string>>")
    return read.select(
        F.coalesce("split_groups", groups).alias("split_groups"), F.coalesce("merge_groups", groups).alias("merge_groups"),
        F.coalesce("exclude", F.array().cast("array<string>")).alias("exclude"),
    )


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link file."""
    whole = _json(spark, path, GRAPH)
    nodes = whole.select(F.explode("nodes").alias("n")).select("n.*")
    place = {k: F.when(F.size(f"order_{k}") > 1, F.struct(F.col(f"order_{k}")[0].alias("lec"), F.col(f"order_{k}")[1].alias("unit"))) for k in ("introduced", "first_used")}
    nodes = nodes.select(F.col("id").alias("name"), *[c for c in nodes.columns if not c.startswith(("id", "order_"))], *[v.alias(f"order_{k}") for k, v in place.items()])
    edges = whole.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.reason", "e.evidence_lecture", "e.evidence_unit")
    return nodes, edges


def read_specs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Injection specs, an array of objects, in their order (k)."""
    return _json(spark, path, schema).drop("file_name", "stem").withColumn("k", F.monotonically_increasing_id())


def read_direct(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Direct-model outputs of injections/<id>/<file>, with the id of their folder."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"id string, {schema}")
    names = [f.split()[0] for f in schema.split(", ")]
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    return read.select(_folder().alias("id"), *names)


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Published counts: (method, course, defect, hits, trials), (method, course, flagged,
    confirmed), and one row of the paired outcomes."""
    cell, rate = "map<string,map<string,int>>", "map<string,struct<flagged:int,confirmed:int>>"
    whole = _json(
        spark, path,
        f"recall struct<injections_per_course_and_type:int,temporal_graph:{cell},direct_model:{cell},paired:map<string,int>>, "
        f"precision struct<temporal_graph:{rate},direct_model:{rate}>",
    )
    methods = ("temporal_graph", "direct_model")
    by_method = F.map_from_arrays(F.array(*map(F.lit, methods)), F.array(*[F.col(f"recall.{m}") for m in methods]))
    recall = whole.select(F.col("recall.injections_per_course_and_type").alias("trials"), F.explode(by_method).alias("method", "cells"))
    recall = recall.select("method", "trials", F.explode("cells").alias("course", "cell")).select("method", "course", F.explode("cell").alias("defect", "hits"), "trials")
    rates = F.map_from_arrays(F.array(*map(F.lit, methods)), F.array(*[F.col(f"precision.{m}") for m in methods]))
    precision = whole.select(F.explode(rates).alias("method", "cells")).select("method", F.explode("cells").alias("course", "c")).select("method", "course", "c.flagged", "c.confirmed")
    paired = whole.select(*[F.col("recall.paired")[k].alias(k) for k in ("both_identified", "temporal_graph_only", "direct_model_only", "both_missed")])
    return recall, precision, paired


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """dataset, id, sentence: the last of equal keys counts."""
    rows = _json(spark, path, "dataset string, id string, sentence string").withColumn("i", F.monotonically_increasing_id())
    return rows.groupBy("dataset", "id").agg(F.max_by("sentence", "i").alias("sentence"))


def with_overlay(clean: DataFrame, overlay: DataFrame) -> DataFrame:
    """spec, lecture_order, lecture_id, text: the clean lectures once for each spec, with the
    one that the spec replaces.

    clean: lecture_order, lecture_id, text; overlay: spec, lecture_id, text (one row a spec).
    The lectures of a course are few and are repeated a spec by design.
    """
    specs = overlay.select("spec", F.col("lecture_id").alias("swapped"), F.col("text").alias("new"))
    both = clean.join(specs)
    return both.select("spec", "lecture_order", "lecture_id", F.when(F.col("lecture_id") == F.col("swapped"), F.col("new")).otherwise(F.col("text")).alias("text"))


