"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of ``docs``; the last returns the windows that ``pack`` lays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm.chaining import remove_passages, repeated_passages
from siftline.llm.common import col, durable, forget, fresh, mark, table
from siftline.llm.langid import identify_languages
from siftline.llm.line_dedup import line_dedup
from siftline.llm.packing import pack
from siftline.llm.simhash import simhash_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language mixture is accepted; ``lang`` is untouched."""
    found = identify_languages(docs)
    accepted = fresh(docs, "languages", "shares", "accepted")[2]
    return found.where(col(accepted)).select(*[col(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows."""
    return line_dedup(docs, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that repeat an earlier document's."""
    return remove_passages(docs, repeated_passages(docs), length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of related documents."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("packing", packing),
]

#: Mixture inference, SimHash, chaining and graph walks are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = mark()
        docs = durable(stage(spark, docs, sf_dir))
        forget(spark, before, keep=1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
