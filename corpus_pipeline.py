"""A training corpus from raw documents: filter, dedup three ways, pack.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. Stages but the
last return the columns of documents; the last gives the pieces of packed sequences with their token ids.

Defined results: null, empty and blank texts fail the base rule of the first stage and go there; taken alone, the
other stages keep one row of the empty texts, keep rows without words or without doc_id, cut nothing from
them, and pack them as their end token. Of equal texts the largest doc_id stays, of near copies the smallest of
those left. Rows repeated whole are one document after exact dedup. Extra columns pass through all stages
but the last, whatever their names. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm.common import shared_dir, stored
from kgspark.llm.exact_dedup import exact_dedup
from kgspark.llm.near_dedup import near_dedup
from kgspark.llm.packing import pack
from kgspark.llm.quality_rules import quality_filter
from kgspark.llm.substring_dedup import substring_cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_filter(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles one stays, the smallest doc_id."""
    return near_dedup(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated 35-word window go."""
    return substring_cut(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("packing", packing),
]

#: Estimation by expectation-maximisation and packing are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
