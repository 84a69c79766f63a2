"""An extension: use before introduction kept up to date over a stream of occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_times(occurrences: DataFrame, key: str, order: Column, introduced: Column, used: Column) -> DataFrame:
    """key, intro, used_at: the earliest times so far, as a streaming aggregation.

    Times are logical, so late rows need no watermark: a minimum takes them in any order.
    State grows with the distinct keys. Write it in `update` or `complete` mode.
    """
    marked = occurrences.select(F.col(key), order.alias("_at"), introduced.alias("_i"), used.alias("_u"))
    return marked.groupBy(key).agg(F.min(F.when(F.col("_i"), F.col("_at"))).alias("intro"), F.min(F.when(F.col("_u"), F.col("_at"))).alias("used_at"))


def violations(times: DataFrame) -> DataFrame:
    return times.where("intro is not null and used_at < intro")
