"""Keywords of the documents' own vocabulary, against every term in every text."""

from lectern.operators import keyword
from lectern.plans import catalog

TEXTS = [
    "we use concat and design patterns. the cap theorem: yes",
    "A Cat is nice. Design Patterns rule. **Bold one** here: x",
    "## 2. Heading Two\nbody CAP - word. Cap Theorem means it. Node.js is fast. J. Smith: he",
    "### Heading Two\nHeading Twofold is. bold one is. C++ is old. **Cat** and **the Saga** Saga — це крок",
    "Orphan Thing lives. ***Odd*** CAP: a. heading two. \u041f\u043e\u0434\u0456\u044f. **\u041f\u043e\u0434\u0456\u044f** x",
    "", "**---** and **...** : x. A\tis b. Zed  -  Y. nothing Zed",
]


def test_whole_keyword(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = keyword.detect_terms(docs.withColumnRenamed("doc_id", "order")).collect()
    for name, kind in (("used_before", "used_before_introduction"), ("orphan", "orphan_concept")):
        got = {tuple(r) for r in catalog.QUERIES[f"keyword_{name}"](spark, str(tmp_path)).collect()}
        assert got == {(r.term, r.appear, r.defo) for r in want if r.kind == kind} and got
