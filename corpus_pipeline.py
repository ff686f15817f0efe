"""From raw documents to token ids: the stages of a training-corpus build.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, whole
texts; a runner may write and reread what one returns before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, exact_dedup, mixing, simhash, toxicity
from loomgraph.llm.shared import keep, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go; it is trained on the labelled ones among them."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.targets())
    return toxicity.clean(docs, chain, "toxic")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays: the longest, then the one with the smallest id."""
    return exact_dedup.distinct_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays."""
    return simhash.distinct_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: documents over the quota go, those of upweighted sources may come twice."""
    drawn = mixing.mix(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))
    return mixing.placed(drawn).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, forget=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Classifiers, fingerprints and token ids are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
