"""A corpus pipeline of five stages; each is one operator over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Nulls, empty texts, repeated rows and empty tables are handled as the
operators' own docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from tidemark.llm.common import Workspace


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents of unknown language go. A score falls with the number of languages, so it drops none."""
    scored = language_id.predict(docs, language_id.fit(docs))
    *kept, pred, _ = scored.columns
    return scored.filter(F.col(pred) != language_id.UNKNOWN).select(*kept)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the longest original stays."""
    return exact_dedup.filter_duplicates(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of documents that links of similarity 0.8 or more connect, one stays."""
    return jaccard_join.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents repeat as their source's rate says."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: a row per piece of a document, with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard_join", distinct_documents),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: The tokenizer and the trained language model are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    work = Workspace(spark, "corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
