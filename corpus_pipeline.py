"""The corpus pipeline: documents in, a sharding manifest of the mixed training set out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All stages but the last return
the columns of documents (and any further ones that the input has).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontamination, mixing, ngram_join, sharding, toxicity
from cairn.llm.shared import discard, scratch, settle, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.clean(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract calls contaminated by the benchmark go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it: once an epoch, and once more if the sample drew it."""
    mixed = mixing.mix(docs, mixing.label_quality(table(spark, sf_dir, "labels")))
    return mixing.repeat(docs, mixed)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of shards: where each row of the mix goes, with its slot, size and checksum."""
    return sharding.manifest(docs, 16)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The fitted model and the n-gram join have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage wrote on the way goes once its output is there, and that once the next stage's is.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
