"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, source mixing, packing.

A stage's result is written before the next one begins, which then removes what its predecessor left
in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import exact_dedup, mixing, packing, quality_rules
from skeinwork.llm.common import materialise, sweep, table
from skeinwork.llm.ngram_join import NgramJaccardJoin
from skeinwork.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules pass."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    sweep(docs)
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles, similarity 0.8 or more."""
    sweep(docs)
    return NgramJaccardJoin(k=5, num=80, den=100).keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none or twice included."""
    sweep(docs)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's token pieces with their places in sequences of at most 2048 tokens."""
    sweep(docs)
    return packing.pack(packing.pieces(docs, *TOKENIZER))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("best-fit packing", pack)]

#: Random rounding and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
