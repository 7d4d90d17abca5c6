"""Registered queries of this subpackage; each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chaining import repeated_passages
from .common import table
from .exact_dedup import exact_dedup
from .langid import identify_languages
from .line_dedup import line_dedup
from .packing import pack
from .pieces import Pieces, encode
from .quality import rank_quality
from .simhash import simhash_dedup
from .topk import search
from .warc import deduplicated_archive, responses


def op1_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "score", "keep")


def op2_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "other_id": "match_doc_id"}).drop("digest")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated_archive(responses(table(spark, sf_dir, "pages")))
    return found.select(F.col("source_id").cast("long").alias("page_id"), "type", "record_id", "url", "digest", "refers_to", "refers_to_uri", "content_length", F.col("payload").cast("string").alias("payload"))


def op5_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "lang", "languages", "shares", "accepted")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")).drop("query")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), length_col="n_chars")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """``model`` is a SentencePiece file; without one, the session names it or the folder of public tokenizers has it."""
    model = model or spark.conf.get("spark.siftline.sentencepiece.model", "/opt/tokenizers/piece_bpe_32k.model")
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), Pieces.load(model), decoded="decoded", keep_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pairwise_quality, op2_fuzzy_passages, op3_exact_dedup, op4_warc_revisits, op5_related_packing, op6_simhash_dedup,
        op7_language_mixture, op8_topk_search, op9_line_dedup, op10_sentencepiece,
    )
}
