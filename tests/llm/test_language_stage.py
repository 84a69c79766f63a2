"""The pipeline's language stage rejects texts that no language holds most of."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_mixed_texts_go_and_prose_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = {r.lang: r.text for r in docs.where("n_chars between 400 and 4000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    words = [long[x].split()[:40] for x in ("de", "en", "fr")]
    mixed = docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit(" ".join(w for x in words for w in x)), "lang": F.lit(None).cast("string")})
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.unionByName(mixed.select(*docs.columns)), "").select("doc_id").collect()}
    assert 10**6 not in kept and len(kept) >= 0.95 * docs.count()
