"""Terms of common words meet only the texts that have their words side by side."""

from pyspark.sql import functions as F

from lectern.operators import keyword

SEPARATORS = ["&&& ", "%%% ", ". ", ".\n", ",### ", " - ", ": ", "$$$ ", " "]


def test_terms_of_common_words_make_few_pairs(spark):
    texts = [(i, f"the{SEPARATORS[i % 8]}word{i:03d} of the rest") for i in range(200)]
    texts = spark.createDataFrame(texts, "order long, lower string")
    terms = spark.createDataFrame([(f"the{SEPARATORS[i % 8]}word{i:03d}", 1000) for i in range(200)], "term string, source long").withColumn("low", F.lower("term"))
    pairs = keyword.seamed(terms, texts).distinct()
    found = pairs.join(texts, "order").where(F.contains("lower", "term"))
    assert {(r.order, r.term) for r in found.collect()} == {(i, f"the{SEPARATORS[i % 8]}word{i:03d}") for i in range(200)}
    assert pairs.count() < 400


def test_seams_lose_no_term(spark):
    words = ["a", "The", "Saga", "Extraordinarily", "of", "Ünïcode9", "Wörter", "X", "Зміст"]
    docs = []
    for i in range(240):
        a, b, c = (words[(i * k + i // 9) % 9] for k in (1, 2, 5))
        s, t = SEPARATORS[i % 9], SEPARATORS[(i // 5) % 9]
        docs.append((i, f"x{a}{s}{b}{t}{c}y **{b.lower()}{t}{c}** and {a}{s}{b}\n{c}" if i < 200 else f"**{a}{s}{b}** **{b}{t}{c}** is. {a}{s}{b}{t}{c} **{b}.** **{c}?!** {a}"))
    docs = spark.createDataFrame(docs[::-1], "order long, text string")
    want = {tuple(r) for r in keyword.detect_terms(docs).select("term", "kind", "appear", "defo").collect()}
    assert {tuple(r) for r in keyword.detect_all(docs).collect()} == want and len(want) > 50
