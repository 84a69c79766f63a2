"""Votes of repeated edge runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clean_name, plain_name


def vote_edges(runs: DataFrame, min_votes: int = 3, keys: tuple[str, ...] = ("lecture_id",)) -> DataFrame:
    """The edges that at least min_votes runs have, in the order in which they first appear.

    runs: keys, run, prerequisites (in order). Ends lose a trailing parenthesis; edges without
    an end don't count; an edge has one vote a run, whatever its spelling; its first spelling
    stands for it. The threshold isn't scaled when runs are missing. Returns keys, from, to,
    reason, evidence_unit, votes, run, pos.
    """
    rows = runs.select(*keys, "run", F.posexplode("prerequisites").alias("pos", "e"))
    rows = rows.select(*keys, "run", "pos", clean_name("e.from").alias("from"), clean_name("e.to").alias("to"), F.col("e.reason").alias("reason"), F.col("e.evidence_unit").alias("evidence_unit"))
    rows = rows.where("`from` <> '' and `to` <> ''")
    first = F.struct("run", "pos")
    kept = rows.groupBy(*keys, plain_name("from").alias("f"), plain_name("to").alias("t")).agg(
        F.count_distinct("run").alias("votes"), F.min_by(F.struct("run", "pos", "from", "to", "reason", "evidence_unit"), first).alias("e")
    )
    return kept.where(F.col("votes") >= min_votes).select(*keys, "e.from", "e.to", "e.reason", "e.evidence_unit", "votes", "e.run", "e.pos")


def consensus(runs: DataFrame, min_votes: int = 3, keys: tuple[str, ...] = ("lecture_id",)) -> DataFrame:
    """keys, prerequisites, n_runs, votes_required: one row for whatever has a readable run."""
    counts = runs.groupBy(*keys).agg(F.count_distinct("run").cast("int").alias("n_runs"))
    edge = F.struct("from", "to", "reason", "evidence_unit")
    kept = vote_edges(runs, min_votes, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "pos", edge.alias("e")))).alias("p"))
    none = F.array().cast("array<struct<`from`:string,`to`:string,reason:string,evidence_unit:string>>")
    found = counts.join(kept, list(keys), "left")
    return found.select(*keys, F.coalesce(F.transform("p", lambda x: x["e"]), none).alias("prerequisites"), "n_runs", F.lit(min_votes).alias("votes_required"))


def vote(rows: DataFrame, key: list[str], voter: str, min_votes: int) -> DataFrame:
    """Keys that at least min_votes distinct voters have, with their number (n_runs)."""
    return rows.groupBy(*key).agg(F.count_distinct(voter).alias("n_runs")).where(F.col("n_runs") >= min_votes)
