"""A training corpus from ``documents``: drop toxic texts, exact and near copies, mix sources, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents. Empty inputs pass through every stage as empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestlake.llm import bpe, common, exact_dedup, mixing, near_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose clauses score below the threshold of the toxicity grammar."""
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return near_dedup.deduplicate(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the Pfair schedule."""
    return mixing.interleave(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and digests, and each document's slot and place in the mix.

    Readers order files as they like and a stage may add no columns, so the places are taken
    again from what the mix left: they follow from the documents alone.
    """
    return bpe.tokenised(mixing.numbered(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The learned lexicon and the similarity graph have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
