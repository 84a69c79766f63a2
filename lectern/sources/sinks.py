"""Writers of course artifacts; all go through Spark, so paths may be in any store it writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import flat, vocabulary_line
from lectern.operators.order import ranked


def write_json(df: DataFrame, path: str, by: str | list[str] | None = None, mode: str = "overwrite") -> None:
    """One JSON object a row; with `by`, a folder for each value, and only those are replaced."""
    keys = [by] if isinstance(by, str) else by or []
    writer = df.write.mode(mode)
    if keys:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    writer.json(path)


def write_text(df: DataFrame, path: str, text: str, by: str | list[str] | None = None) -> None:
    """The text of each row as a file's content, in a folder for each key."""
    keys = [by] if isinstance(by, str) else by or []
    writer = df.select(*keys, F.col(text).alias("value")).write.mode("overwrite")
    if keys:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    writer.text(path)


def write_files(df: DataFrame, path: str, name: str, text: str) -> None:
    """The text of each row as a file of its own under its name, as tools by file name expect.

    Rows come to the driver one at a time. For course artifacts, which are few; tables of any
    size go by `write_text` and `write_json`.
    """
    sc = df.sparkSession.sparkContext
    for row in df.select(F.col(name).alias("n"), F.col(text).alias("t")).toLocalIterator():
        place = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{row.n}")
        out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place, True)
        out.write((row.t or "").encode("utf-8"))
        out.close()


def write_lectures(lectures: DataFrame, path: str) -> None:
    write_json(lectures.withColumn("id", F.col("lecture_id")), path, "id")


def write_rendered(rendered: DataFrame, path: str) -> None:
    write_text(rendered, path, "text", "lecture_id")


def write_injected(injected: DataFrame, path: str) -> None:
    """Injected lectures by spec. Only the specs written are replaced; others stay."""
    write_text(injected, path, "text", ["spec", "lecture_id"])


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest as one array by lecture order (equal ones as they come), in manifest.json."""
    row = F.struct(*manifest.columns)
    rows = manifest.select(F.struct(F.col("lecture_order").alias("o"), F.monotonically_increasing_id().alias("k"), row.alias("r")).alias("x"))
    whole = rows.agg(F.array_sort(F.collect_list("x")).alias("a")).select(F.to_json(F.transform("a", lambda x: x["r"])).alias("text"))
    write_files(whole.withColumn("name", F.lit("manifest.json")), path, "name", "text")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as tables, which a course of any size can have."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def _in_order(place: str, value: str) -> Column:
    """The values of a column by place; values that hold maps can't be compared themselves."""
    rows = F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v")))
    return F.transform(F.array_sort(rows, lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0)), lambda x: x["v"])


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of `nodes` and `edges`, for tools that read one document. The whole graph is
    one value, so it is meant for single courses."""
    place = {k: F.when(F.col(f"order_{k}").isNotNull(), F.array(F.col(f"order_{k}.lec"), F.col(f"order_{k}.unit"))).alias(f"order_{k}") for k in ("introduced", "first_used")}
    own = [c for c in ("aliases", "definitions", "appearances", "roles", "n_introduced", "n_used", "lecture_introduced", "unit_introduced", "lecture_first_used", "unit_first_used") if c in nodes.columns]
    n = nodes.orderBy("place").select(F.col("place"), F.struct(F.col("name").alias("id"), F.col("name").alias("canonical_name"), *own, *place.values()).alias("n"))
    e = edges.select("first_seq", F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "reason", "evidence_lecture", "evidence_unit").alias("e"))
    left = n.agg(_in_order("place", "n").alias("nodes"))
    right = e.agg(_in_order("first_seq", "e").alias("edges"))
    return left.join(F.broadcast(right)).select(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "edges")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, place, value: the lines of a GraphML document; every attribute is a string."""

    def escape(c):
        out = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
        return F.regexp_replace(out, '"', "&quot;")

    def data(df: DataFrame, skip: tuple[str, ...]):
        kinds = dict(df.dtypes)
        return F.concat(*[F.concat(F.lit(f'<data key="{c}">'), escape(flat(F.col(c), kinds[c])), F.lit("</data>")) for c in df.columns if c not in skip], F.lit(""))

    own = {c: "node" for c in nodes.columns if c not in ("spec", "name", "place")} | {c: "edge" for c in edges.columns if c not in ("spec", "src", "dst", "first_seq")}
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="string"/>' for c, kind in own.items()] + ['<graph edgedefault="directed">']
    spark = nodes.sparkSession
    first = spark.createDataFrame([(0, i, v) for i, v in enumerate(head)], "part int, place long, value string")
    last = spark.createDataFrame([(3, 0, "</graph>"), (3, 1, "</graphml>")], "part int, place long, value string")
    n = ranked(nodes, ["place"], "_k").select(F.lit(1).alias("part"), F.col("_k").alias("place"), F.concat(F.lit('<node id="'), escape(F.col("name")), F.lit('">'), data(nodes, ("spec", "name", "place")), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.col("first_seq").cast("long").alias("place"), F.concat(F.lit('<edge source="'), escape(F.col("src")), F.lit('" target="'), escape(F.col("dst")), F.lit('">'), data(edges, ("spec", "src", "dst", "first_seq")), F.lit("</edge>")).alias("value"))
    return first.unionByName(n).unionByName(e).unionByName(last).orderBy("part", "place")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graphml(nodes, edges).select("value").coalesce(1).write.mode("overwrite").text(path)


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """A table for each detector, and the counts."""
    for kind, df in report.items():
        df.write.mode("overwrite").json(f"{path}/{kind}")


def vocabulary_text(nodes: DataFrame) -> DataFrame:
    """The vocabulary list of a graph, by lower-case name."""
    return nodes.orderBy(F.lower("name"), "place").select(vocabulary_line(F.col("name"), F.col("aliases")).alias("value"))


def write_vocabulary(nodes: DataFrame, path: str) -> None:
    vocabulary_text(nodes).coalesce(1).write.mode("overwrite").text(path)


def course_text(parts: DataFrame, keys: tuple[str, ...] = ("spec",), order: str = "lecture_order", then: str = "lecture_id", text: str = "text", between: str = "\n\n") -> DataFrame:
    """keys, text: the texts of a course, in order, as one."""
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(then).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("p"))
    return rows.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), between).alias("text"))


def write_course(parts: DataFrame, path: str) -> None:
    write_text(course_text(parts), path, "text", "spec")


def write_overrides(overrides: DataFrame, path: str) -> None:
    """Replaces the overrides; the one row is read before the old file goes."""
    row = overrides.collect()
    overrides.sparkSession.createDataFrame(row, overrides.schema).coalesce(1).write.mode("overwrite").json(path)
