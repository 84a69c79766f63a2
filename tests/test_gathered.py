"""Occurrences that say the same at the same place are one row, however many they are."""

from pyspark.sql import functions as F

from lectern.operators import detect, resolve
from lectern.operators.concept_graph import build_nodes
from lectern.sources.course import EXTRACTION, read_overrides


def test_rows_grow_with_places_not_with_occurrences(spark):
    same = ("Queue", [], None, "01#01", "used")
    said = ("Queue", ["FIFO"], "a list", "02#01", "introduced")
    rows = [("l1", [same] * 500, []), ("l2", [said, said, same], [])]
    lectures = spark.createDataFrame(rows, EXTRACTION).withColumns({"spec": F.lit("clean"), "pos": F.col("lecture_id")})
    order = spark.createDataFrame([("l1", 1), ("l2", 2)], "lecture_id string, lecture_order int")
    found = resolve.resolve(lectures, order, read_overrides(spark))
    assert found.members.count() == 4  # those with a definition stay apart
    row = found.concepts.first()
    assert [(a.lecture, a.unit, a.role, a.n) for a in row.appearances] == [("l1", "01#01", "used", 500), ("l2", "02#01", "introduced", 2), ("l2", "01#01", "used", 1)]
    assert row.roles == {"introduced": 2, "used": 501} and len(row.definitions) == 2 and found.stats.first().raw_concept_occurrences == 503
    assert detect.used_before_introduction(build_nodes(found.concepts)).first().n_used_before == 500
