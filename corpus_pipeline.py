"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each
result as Parquet in the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import common, mixing, near_dedup, packing, pii, quality_classifier


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(spark, docs, sf_dir)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: shingles of five words, similarity 0.8."""
    return near_dedup.keep_first(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards flatter shares of sources, languages and topics."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("near duplicates", dedup), ("personal data", private), ("mixing", mixture), ("packing", packed)]

#: The classifier, the sampling draw over fitted weights and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's own tables, and the stage's before it, go as soon as its result is written."""
    store = common.Store(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = len(common.Store.made)
        docs = store.put(str(k), stage(spark, docs, sf_dir))
        for own in common.Store.made[before:]:
            own.close()
        store.drop(str(k - 1))
    return docs
