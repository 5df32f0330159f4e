"""Training-corpus pipeline over ``documents``: each stage calls one operator of ``ringlens.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of ``documents``; the last returns one row of token digests a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringlens.llm import bpe, mixing, simhash, substring, toxicity
from ringlens.llm.common import Scratch, read

#: Target shares of tokens after mixing.
MIX = {"good": 0.92, "low": 0.08}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scores reject go."""
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the one with the smallest id, rows without id last."""
    return simhash.one_of_each_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand in an earlier document are cut out of the text."""
    return substring.remove_repeats(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at the rates that bring the domains' token totals to their target shares; none is repeated.

    The good domain is kept whole. Toxic documents are gone by now, so they are no domain here.
    """
    return mixing.apply_mix(docs, read(spark, sf_dir, "labels"), targets=MIX, domains={d: mixing.DOMAINS[d] for d in MIX}, most=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_domains),
    ("bpe", encode),
]

#: XXH64, BPE and the fitted models have no SQL form; tests/llm compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each result is written as Parquet and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
