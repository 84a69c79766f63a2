"""Texts that hold many terms are searched once, not once for each of them."""

import random

from pyspark.sql import functions as F

from lectern.operators import keyword

PIECES = ["Cat", "cat theory", "Theory", "CAT", "is", "IS ", "means", "meanse", " : ", "x", ": ", " - ", "—", " – це ", "-це", "**", "##", "\n## ", "\n### \n", "\n#######", "\n", " ", "  ", "_", "9", "ſtraße", "Straße", "Ünï", "ß"]
TERMS = ["Cat", "Cat Theory", "Theory", "Straße", "ünï", "Nowhere", "Is", "x", "##x", "# Cat"]


def test_first_places_are_those_of_patterns(spark):
    r = random.Random(3)
    docs = [(i, "".join(r.choice(PIECES) for _ in range(r.randrange(9)))) for i in range(3000)] + [(9000, None)]
    r.shuffle(docs)
    parts = spark.createDataFrame(docs, "order long, text string")
    # Each text alone, so that every one of them counts.
    rows = parts.select(F.col("order").alias("k"), "order", "text")
    vocab = spark.createDataFrame([(t,) for t in TERMS], "term string")
    want = {(x.order, x.term): x.defo is not None for x in keyword.first_places(rows, rows.select("k").join(vocab), ("k",)).withColumnRenamed("appear", "order").collect()}
    got = {}
    for x in docs[:400]:
        low = keyword._folded(x[1] or "")
        ends, stars, heads = keyword._definition_places(low)
        for t in TERMS:
            if x[1] and t.lower() in x[1].lower():
                key, n = keyword._folded(t), len(t)
                at = [b for b in range(len(low)) if low.startswith(key, b)]
                got[x[0], t] = any(b + n in ends or b + n in stars and b > 1 and low[b - 2 : b] == "**" or b in heads and not (low[b + n : b + n + 1].isalnum() or low[b + n : b + n + 1] == "_") for b in at)
    assert got and got == {k: v for k, v in want.items() if k[0] in {x[0] for x in docs[:400]}}
    first = {}
    for (order, term), defined in want.items():
        a, d = first.get(term, (None, None))
        first[term] = (order if a is None else min(a, order), d if not defined else order if d is None else min(d, order))
    found = keyword.first_places(parts.repartition(3), vocab)
    assert {x.term: (x.appear, x.defo) for x in found.collect()} == first and len(first) > 6


def test_texts_meet_no_pattern_of_a_term(spark):
    parts = spark.createDataFrame([(1, "Cat is x")], "order long, text string")
    vocab = spark.createDataFrame([("Cat",)], "term string")
    plan = keyword.first_places(parts, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "Generate" not in plan
    assert keyword.first_places(parts, vocab.limit(0)).count() == 0
