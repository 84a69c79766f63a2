"""A course of three lectures, small enough to work out by hand."""

from pyspark.sql import functions as F

from lectern.operators.resolve import resolve
from lectern.sources.course import EXTRACTION, read_overrides

MANIFEST = [("01-a", 1), ("02-b", 2), ("03-c", 3)]
OCCURRENCES = [
    ("01-a", "Alpha", [], "introduced", "01#01", "d"), ("01-a", "Beta", [], "used", "01#02", ""), ("01-a", "Gamma", [], "used", "01#02", ""), ("01-a", "модульний моноліт", [], "introduced", "01#03", "d"),
    ("02-b", "Beta", ["BT"], "introduced", "02#01", "one"), ("02-b", "Alpha", [], "used", "02#01", ""), ("02-b", "класичний моноліт", ["моноліт"], "introduced", "02#02", "d"), ("02-b", "Delta", [], "used", "02#03", ""),
    ("03-c", "Delta", [], "introduced", "03#01", "d"), ("03-c", "Beta", [], "introduced", "03#02", "two"), ("03-c", "моноліт", [], "used", "03#03", ""),
]
EDGES = [
    ("01-a", "Beta", "Alpha", "01#01"), ("02-b", "Alpha", "Beta", "02#01"), ("02-b", "BT", "Beta", "02#01"), ("03-c", "Beta", "Delta", "03#01"), ("03-c", "Delta", "Alpha", "03#02"),
    ("03-c", "Zeta", "Alpha", "03#02"), ("03-c", "Beta", "Alpha", "03#02"),
]


def manifest(spark):
    return spark.createDataFrame(MANIFEST, "lecture_id string, lecture_order int")


def extractions(spark, edges=EDGES, occurrences=OCCURRENCES, spec=None):
    rows = [
        (l, [(n, a, d, u, r) for x, n, a, r, u, d in occurrences if x == l], [(f, t, "", u) for x, f, t, u in edges if x == l], l)
        for l, _ in MANIFEST
    ]
    df = spark.createDataFrame(rows, f"{EXTRACTION}, pos string")
    return df if spec is None else df.withColumn("spec", F.lit(spec))


def overrides(spark, split=(), merge=(), exclude=()):
    if not (split or merge or exclude):
        return read_overrides(spark)
    return spark.createDataFrame([([list(g) for g in split], [list(g) for g in merge], list(exclude))], "split_groups array<array<string>>, merge_groups array<array<string>>, exclude array<string>")


def units(spark):
    rows = [("02-b", "02#03", "see [Delta](delta.md)"), ("01-a", "01#02", "plain"), ("02-b", "02#01", "text")]
    return spark.createDataFrame(rows, "lecture string, unit string, text string")


def resolved(spark, **kw):
    edges = kw.pop("edges", EDGES)
    return resolve(extractions(spark, edges, spec="clean"), manifest(spark), overrides(spark, **kw))
