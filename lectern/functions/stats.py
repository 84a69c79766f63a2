"""Exact tests and intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard normal quantile of a two-sided 95 % interval (fixed value).
Z = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson score interval of k in n, clamped to 0..1; n = 0 raises."""
    n = F.when(n > 0, n.cast("double")).otherwise(F.raise_error(F.lit("Wilson interval of no trials")).cast("double"))
    p = k / n
    width = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / width
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / width
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def _upto(n: Column) -> Column:
    """0..n, empty for n under 0."""
    n = n.cast("int")
    return F.when(n < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n))


def _log_choose(n: Column, k: Column) -> Column:
    """ln of n over k as a sum of k logarithms of ratios."""
    steps = F.filter(_upto(k), lambda i: i > 0)
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((n - k + i).cast("double")) - F.log(i.cast("double")))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p of the discordant counts; 1 without any.

    The tail is summed as ratios to its largest term, so large counts don't underflow.
    """
    n, k = b + c, F.least(b, c)
    terms = F.aggregate(
        _upto(k), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (k - i) / (n - k + i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
    )["sum"]
    return F.least(F.lit(1.0), 2 * F.exp(_log_choose(n, k) - n * F.log(F.lit(2.0))) * terms)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact Fisher p of a 2x2 table: tables no likelier than it, of its margins.

    Each table's probability is reached from the observed one by ratios, in both directions.
    """
    row1, row2, col1 = a + b, c + d, a + c
    low, high = F.greatest(F.lit(0), col1 - row2), F.least(row1, col1)

    def walk(steps: Column, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(1.0).alias("all"))

        def step(s: Column, i: Column) -> Column:
            p = s["p"] * ratio(i)
            return F.struct(p.alias("p"), (s["sum"] + F.when(p <= 1 + 1e-9, p).otherwise(0.0)).alias("sum"), (s["all"] + p).alias("all"))

        return F.aggregate(steps, start, step)

    def up(i: Column) -> Column:  # from the table x = a + i to x + 1
        x = (a + i).cast("double")
        return (row1 - x) * (col1 - x) / ((x + 1) * (row2 - col1 + x + 1))

    def down(i: Column) -> Column:
        x = (a - i).cast("double")
        return x * (row2 - col1 + x) / ((row1 - x + 1) * (col1 - x + 1))

    more, fewer = walk(_upto(high - a - 1), up), walk(_upto(a - low - 1), down)
    return F.least(F.lit(1.0), (1.0 + more["sum"] + fewer["sum"]) / (more["all"] + fewer["all"] - 1.0))


def describe(k: Column, n: Column) -> Column:
    low, high = wilson(k, n)
    return F.format_string("%d/%d = %.3f, 95%% Wilson CI %.3f-%.3f", k, n, k / n, low, high)
