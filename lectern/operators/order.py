"""Numbering rows in an order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import saved

#: Bits of monotonically_increasing_id below those of the partition.
_ROW_BITS = 33


def ranked(rows: DataFrame, order: list, name: str = "k") -> DataFrame:
    """rows with their place in an order, from 0; ties are broken at will.

    Rows are sorted over the cluster and written once; the counts of the sorted partitions (a
    row each) are summed up, and each row adds its place in its partition.
    """
    kept = saved(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = kept.join(F.broadcast(before), part == F.col("_part"))
    return placed.withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft(part, _ROW_BITS)).drop("_id", "_part", "_n", "_before")


def numbered_within(rows: DataFrame, keys: list[str], group: str, order: list[str], name: str) -> DataFrame:
    """rows with their number among those of equal keys, from 0, by (group, order).

    Groups are numbered apart and then moved on by the rows of the groups before; only their
    counts meet.
    """
    by = Window.partitionBy(*keys, group)
    counts = rows.groupBy(*keys, group).agg(F.count("*").alias("_n"))
    before = counts.select(*keys, group, (F.sum("_n").over(Window.partitionBy(*keys).orderBy(group)) - F.col("_n")).alias("_before"))
    own = rows.withColumn("_r", F.row_number().over(by.orderBy(*order)))
    return own.join(before, [*keys, group]).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_before", "_r")
