"""A training corpus from documents: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. run() writes every stage as Parquet in the shared folder and reads it again for the next.
Classifiers learn from the labels in sf_dir, from the rows that their queries learn from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echotrace.llm import packing, quality, simhash, toxicity
from echotrace.llm.common import table, written
from echotrace.llm.labelled import remainder, sample

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of THRESHOLD or more."""
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    return quality.keep(docs, quality.fit(sample(table(spark, sf_dir, "documents"), labels, "quality")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under THRESHOLD."""
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2)
    return toxicity.drop(docs, toxicity.fit(sample(table(spark, sf_dir, "documents"), labels, "toxic")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.keep_one(docs, shingle=SHINGLE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: Classifiers, fingerprints and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
