"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

quality -> exact_dedup -> near_dedup -> decontamination -> packing. All stages but the
last return the columns of documents. A stage works on every row its predecessor kept:

- quality drops documents that the classifier scores below its threshold;
- exact_dedup keeps one row of equal texts;
- near_dedup keeps the first document of each group (five words, similarity 0.8);
- decontamination cuts benchmark passages out of the texts and keeps every document;
- packing returns the pieces of the token sequences.

Rows are judged by their own text, not by doc_id: rows that repeat a doc_id with other
texts, or have none, are kept or dropped one by one (of equal rows one stays). Null and
empty texts take part as empty ones: the classifier scores them, exact_dedup keeps one of
what it is given, near_dedup links none, packing gives each its end id. Empty tables give
empty results; other columns of documents are carried along up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from skarn.llm.common import saved, table

#: No SQL for these rows: a trained network decides in the first stage.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col(quality.SCORE) >= quality.CUT).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.distinct_texts(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return near_dedup.distinct_documents(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the passages of benchmark cut out."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}-{name}")
    return docs
