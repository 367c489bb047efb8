"""A corpus pipeline: quality classifier, exact and near de-duplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.  Nulls, empty texts, ties
and repeated rows are handled as the operators' own docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.llm import exact_dedup, mixing, near_copies, packing, quality_classifier
from saltmarsh.llm.common import documents, fold, labels, shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside fold 1 of 3, does not reject."""
    model = quality_classifier.fit(docs, labels(spark, sf_dir), "quality", lambda c: fold(c, 3) != 1)
    return quality_classifier.keep_good(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with Jaccard similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, possibly not at all."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 1024 tokens, as op2_packing returns them."""
    return packing.packed_digest(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: No stage but exact de-duplication can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
