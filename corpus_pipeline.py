"""A corpus-cleaning pipeline over `documents`, of operators of lectern.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents. All but the last return the columns of their input.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, decontaminate, jaccard, language, suffixes
from lectern.llm.common import read
from lectern.session import shared_folder

#: The share of its words that a document's language holds at least. Of 10,000 documents of sf0.1,
#: 20 hold less; those looked at are scraps of a word or two, secrets and numbers, mixed languages and
#: words cut by symbols.
LEAST_SHARE = 0.7


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: null texts, texts without a letter, and texts of
    which no language holds LEAST_SHARE of the words.

    The labeller learns from a bounded sample of the stage's own documents (language.train);
    where no language could be learned, only texts without a letter go.
    """
    return language.keep(docs, language.train(docs), least=LEAST_SHARE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more join, the one with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too leave the texts."""
    return suffixes.cut(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Test passages leave the texts; a document that is mostly test text goes."""
    return decontaminate.cut(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is kept, encoded and decoded again."""
    return bpe.digest(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", without_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: SQL can't express the first stage's model nor the last one's vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is kept in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/tables/{uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
