"""A training corpus from raw documents: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage works on all rows that the stage
before has kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import contamination, mixing, queries, simhash, tokens, toxicity
from millrace.llm.frames import saved, ship, table

#: No SQL: nearest examples, SimHash, rounding and tokenizing are not SQL's.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below its threshold. Labels of
    held-out rows are not learnt from, and labels decide nothing themselves."""
    ship(spark)
    voter = queries.toxic_voter(spark, sf_dir, docs)
    return toxicity.reject_toxic(docs, voter, threshold=queries.TOXIC_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints that link at two or fewer bits."""
    ship(spark)
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items cut out; documents mostly made of them go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, limit=2.0)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and checksum of each document in the token files written."""
    ship(spark)
    return tokens.token_report(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark_passages", drop_benchmark_passages),
    ("source_mix", mix_sources),
    ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
