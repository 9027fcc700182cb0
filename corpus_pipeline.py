"""A training corpus from raw documents: five stages, each stored before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quincunx.llm import mixing, packing, quality, secretscan, similar
from quincunx.llm.common import table, written
from quincunx.llm.queries import END_ID, LEVELS, MIX_SHARE, SEED, VOCABULARY, WEIGHTS


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops what the quality rules or the trees reject."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, folder, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the first document of each group of near copies (five-word shingles, Jaccard 0.8)."""
    return similar.first_of_similar(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Masks live secrets; every document stays."""
    return secretscan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the documents with a part in one epoch at most of the target mixture."""
    return mixing.mixed(docs, LEVELS, WEIGHTS, share=MIX_SHARE, seed=SEED)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), end_id=END_ID)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", one_of_each),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Boosted trees, SimHash and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
