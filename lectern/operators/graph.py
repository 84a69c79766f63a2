"""Graph operators on edge tables: components, closure, rank."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import Scratch


#: Labels that a broadcast may hold; more are joined by shuffles.
BROADCAST_NODES = 500_000
#: Paths of two edges above which a closure first takes the pairs by way of one node.
DENSE = 2_000_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None) -> DataFrame:
    """node, component: the smallest node that undirected edges lead to.

    Alternating stars: all larger neighbours of a node are linked to the least node around it,
    then all smaller ones and the node itself to the least of them, until every node hangs on
    its component's least. The least around a node is aggregated before it meets the node's
    edges, and nodes that are the least around themselves, which in the end have the most edges,
    keep theirs. Nodes come from the edges and, if given, from `nodes` (one column). Loops,
    repeated edges and nulls in edges are ignored.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    scratch = Scratch(edges.sparkSession)
    # Of an edge, u is the larger end.
    stars = scratch.save(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    small = F.broadcast if stars.count() <= BROADCAST_NODES else lambda df: df
    state = None
    while True:
        stars = _small_star(_large_star(stars, small), small)
        stars = scratch.save(stars)
        scratch.drop(stars)
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if nodes is None:
        return found.union(found.select("component", "component").distinct())
    own = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct()
    return own.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(stars: DataFrame, small) -> DataFrame:
    both = stars.union(stars.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")
    near = both.where("v > u").join(small(least), "u", "left")
    return near.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()


def _small_star(stars: DataFrame, small) -> DataFrame:
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    near = stars.join(small(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(near).distinct()


def reached(arcs: DataFrame, start: DataFrame, scratch: Scratch, f: str, t: str) -> DataFrame:
    """x of the nodes to which a path of one arc or more leads from start (one column, x)."""
    step = arcs.select(F.col(f).alias("x"), F.col(t).alias("y"))
    known = frontier = scratch.save(step.join(F.broadcast(start), "x").select(F.col("y").alias("x")).distinct())
    while True:
        near = step.join(frontier, "x").select(F.col("y").alias("x")).distinct()
        frontier = scratch.save(near.join(known, "x", "left_anti"))
        if frontier.isEmpty():
            return known
        known = scratch.save(known.unionByName(frontier))


def transitive_closure(edges: DataFrame, src: str = "src", dst: str = "dst", dense: int = DENSE) -> DataFrame:
    """f, t: every pair joined by a path of one edge or more, (x, x) on cycles included.

    Strongly connected parts count as one node: what leads to one of its nodes leads to all. The
    closure is that of the graph of parts, which has no cycles, with each part's pairs put in last.
    """
    from lectern.operators.cycles import strong_parts

    step = edges.select(F.col(src).alias("f"), F.col(dst).alias("t")).where("f is not null and t is not null").distinct()
    scratch = Scratch(edges.sparkSession)
    first = scratch.save(step)
    parts = strong_parts(first, "f", "t")
    n = parts.count()
    if n == 0:
        return _closed(first, dense)
    small = F.broadcast if n <= BROADCAST_NODES else lambda df: df
    ends = [small(parts.select(F.col("node").alias(x), F.col("part").alias(f"p{x}"))) for x in ("f", "t")]
    labelled = first.join(ends[0], "f", "left").join(ends[1], "t", "left")
    outer = scratch.save(labelled.select(F.coalesce("pf", "f").alias("f"), F.coalesce("pt", "t").alias("t"), (F.col("pf").isNull() & (F.col("f") == F.col("t"))).alias("loop")).where("f <> t or loop").distinct())
    loops = outer.where("loop").select("f", "t")
    between = _closed(outer.where("f <> t").select("f", "t"), dense)
    scratch.drop(outer)
    ends = [small(parts.select(F.col("part").alias(x), F.col("node").alias(f"n{x}"))) for x in ("f", "t")]
    between = between.join(ends[0], "f", "left").join(ends[1], "t", "left").select(F.coalesce("nf", "f").alias("f"), F.coalesce("nt", "t").alias("t"))
    # A part's nodes are few rows and many pairs: they are dealt to all tasks first.
    dealt = parts.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node").select(F.col("node").alias("f"), "part")
    inside = dealt.join(small(parts.select(F.col("node").alias("t"), "part")), "part").select("f", "t")
    return inside.unionByName(loops).unionByName(between)


def _closed(edges: DataFrame, dense: int) -> DataFrame:
    """transitive_closure of distinct edges (f, t), without regard to parts.

    Semi-naive: only the pairs found by the step before are joined again with the edges. With
    more than `dense` paths of two edges, all pairs by way of one busy node come first: what
    reaches it, times what it reaches. Any other path starts outside the one or ends outside
    the other, and so do all its edges; only those are joined.
    """
    scratch = Scratch(edges.sparkSession)
    first = known = frontier = scratch.save(edges)
    ways = first.groupBy(F.col("t").alias("x")).agg(F.count("*").alias("n_in")).join(first.groupBy(F.col("f").alias("x")).agg(F.count("*").alias("n_out")), "x")
    ways = scratch.save(ways.select("x", (F.col("n_in") * F.col("n_out")).alias("n")))
    if (ways.agg(F.sum("n")).first()[0] or 0) > dense:
        busy = ways.orderBy(F.desc("n"), "x").limit(1).select("x")
        before = reached(first, busy, scratch, "t", "f").union(busy).distinct()
        after = reached(first, busy, scratch, "f", "t")
        # The busy node itself is a start; it is an end only if it is on a cycle.
        ends = scratch.save(before.select(F.col("x").alias("f"))), scratch.save(after.select(F.col("x").alias("t")))
        through = ends[0].crossJoin(F.broadcast(ends[1]))
        rest = scratch.save(first.join(ends[0], "f", "left_anti").select("f", "t").union(first.join(ends[1], "t", "left_anti").select("f", "t")).distinct())
        # Again only where that pays.
        left = _closed(rest, dense if 2 * rest.count() <= first.count() else sys.maxsize)
        found = scratch.save(through.union(left).distinct())
        scratch.drop(found)
        return found
    arcs = known.select(F.col("f").alias("m"), F.col("t").alias("n"))
    while True:
        longer = frontier.join(arcs, frontier.t == arcs.m).select("f", F.col("n").alias("t")).distinct()
        frontier = scratch.save(longer.join(known, ["f", "t"], "left_anti"))
        if frontier.isEmpty():
            scratch.drop(known)
            return known
        known = scratch.save(known.unionByName(frontier))
        scratch.drop(first, known, frontier)


def ancestors(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """f, t with f <> t, and whether no direct edge joins them."""
    direct = edges.select(F.col(src).alias("f"), F.col(dst).alias("t"), F.lit(True).alias("direct")).distinct()
    closed = transitive_closure(edges, src, dst).where("f <> t")
    return closed.join(direct, ["f", "t"], "left").select("f", "t", F.col("direct").isNull().alias("transitive"))


def pagerank(
    edges: DataFrame, nodes: DataFrame, damping: float = 0.85, max_steps: int = 100, tolerance: float | None = 1e-6,
    src: str = "src", dst: str = "dst",
) -> DataFrame:
    """node, rank: unweighted PageRank with the mass of nodes without out-edges dealt evenly.

    Rank flows from src to dst. It stops when the L1 change falls under N * tolerance, or
    after max_steps (tolerance None: exactly max_steps); without convergence all ranks are
    null, for the caller's fallback. Edges are written once and stay where they are while the
    nodes are few enough for their shares to be sent along.
    """
    arcs = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null").distinct()
    own = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    degree = arcs.groupBy("s").agg(F.count("*").alias("out"))
    scratch = Scratch(edges.sparkSession)
    own = scratch.save(own.join(degree, own.node == degree.s, "left").select("node", F.coalesce("out", F.lit(0)).alias("out")))
    flow = scratch.save(arcs.join(own, arcs.s == own.node, "left_semi"))
    n = own.count()
    few = F.broadcast if n <= BROADCAST_NODES else lambda df: df
    ranks = scratch.save(own.select("node", "out", F.lit(1.0 / n if n else 0.0).alias("rank")))
    for step in range(max_steps):
        # What nodes without out-edges hold, and what the last step moved, in one pass.
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0)).alias("v")).first().v
        base = (1.0 - damping) / n + damping * loose / n if n else 0.0
        shares = ranks.where("out > 0").select("node", (F.col("rank") / F.col("out")).alias("share"))
        sent = flow.join(few(shares), flow.s == shares.node).groupBy("d").agg(F.sum("share").alias("got"))
        new = ranks.join(few(sent), ranks.node == sent.d, "left").select(
            "node", "out", F.col("rank").alias("old"), (F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank")
        )
        new = scratch.save(new)
        scratch.drop(flow, new)
        if tolerance is not None:
            moved = new.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0)).alias("v")).first().v
            if moved < n * tolerance:
                return new.select("node", "rank")
        ranks = new.select("node", "out", "rank")
    ranks = ranks.select("node", "rank")
    return ranks if tolerance is None else ranks.select("node", F.lit(None).cast("double").alias("rank"))


def importance(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, max_steps: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """node, importance: PageRank over its maximum; 1.0 for all if it doesn't converge."""
    ranks = pagerank(edges, nodes, damping, max_steps, tolerance)
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(F.broadcast(top)).select("node", F.coalesce(F.col("rank") / F.col("top"), F.lit(1.0)).alias("importance"))


def counts(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """n_nodes, n_edges of distinct edges."""
    nodes = edges.select(src).union(edges.select(dst)).agg(F.count_distinct(src).alias("n_nodes"))
    return nodes.join(edges.agg(F.count("*").alias("n_edges")))
