"""Corpus pipeline: from the ``documents`` table to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``docs``.

Defined results: null texts fail the quality rules; empty tables stay empty; extra columns
pass through all stages but the last; rows that repeat an id and its text are reduced to
one by the exact-deduplication stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parlance.llm import dedup, jaccard, langid, packing, quality
from parlance.llm.common import documents, stored
from parlance.llm.queries import WORD_TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive thresholds keep."""
    return quality.quality_filter(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least half the words are in one learned language; if no row has
    a label to learn from, none can be judged and all that have letters stay."""
    return langid.language_filter(docs, keep_unjudged=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the smallest id."""
    return jaccard.drop_near_copies(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("packing", sequences),
]

#: Language ID and the set join can't be written as SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
