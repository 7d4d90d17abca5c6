"""Queries on models, costs, embeddings and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from .registry import Tables, query


@query("cost_estimate", """
    WITH c AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 400000 AS n FROM orders), m AS (SELECT *, n / 1e6 AS m FROM c)
    SELECT o_orderkey, round(CASE WHEN m <= 250 THEN m * 20 WHEN m <= 2500 THEN 20000 + (m - 250) * 60 WHEN m <= 4000 THEN 155000 + (m - 2500) * 40 ELSE 215000 + (m - 4000) * 30 END, 6) AS google, round(5 + m * 20, 6) AS deepl FROM m
""")
def cost_estimate(t: Tables) -> DataFrame:
    n = F.col("o_orderkey") * 400000
    return t.orders.select("o_orderkey", F.round(M.google_cost(n), 6).alias("google"), F.round(M.deepl_cost(n), 6).alias("deepl"))


@query("model_answers", "SELECT doc_id, CASE WHEN text <> '' THEN reverse(upper(replace(text, 'ß', 'ss'))) END AS text_out, text <> '' AS success, CASE WHEN text = '' THEN 'empty text' END AS error_message FROM documents")
def model_answers(t: Tables) -> DataFrame:
    out = M.run_model(t.documents.select("doc_id", F.replace("text", F.lit("ß"), F.lit("ss")).alias("text")), "text", M.ModelSettings(instructions=("upper", "reverse")))
    return out.select("doc_id", "text_out", "success", "error_message")


@query("model_labels", r"SELECT conv_id, turn, m AS model, regexp_split_to_array(trim(text), '\s+')[1] AS text_out, round(-length(text) / 1000.0, 6) AS logprob, round(exp(-length(text) / 1000.0), 6) AS proba FROM conversations CROSS JOIN (SELECT unnest(['a', 'b']) AS m) WHERE text <> ''")
def model_labels(t: Tables) -> DataFrame:
    s = M.ModelSettings(instructions=("first",))
    out = M.run_models(t.conversations.where("text <> ''"), "text", {"a": s, "b": s})
    return out.select("conv_id", "turn", "model", "text_out", F.round("logprob", 6).alias("logprob"), F.round("proba", 6).alias("proba"))


@query("probabilities", "SELECT vec_id, round(exp(list_sum(list_transform(embedding, lambda x: -abs(x::DOUBLE)))), 6) AS proba FROM embeddings")
def probabilities(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(M.probability(F.transform("embedding", lambda x: -F.abs(x.cast("double")))), 6).alias("proba"))


@query("cached_translation", "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'cached' ELSE coalesce(CASE WHEN EXISTS (SELECT 1 FROM conversations z WHERE z.turn = 0 AND replace(z.text, 'ß', 'ss') = c.text) THEN 'cached' END, upper(text)) END AS translated_text FROM (SELECT conv_id, turn, replace(text, 'ß', 'ss') AS text FROM conversations) c WHERE text <> ''")
def cached_translation(t: Tables) -> DataFrame:
    rows = t.conversations.where("text <> ''").withColumn("text", F.replace("text", F.lit("ß"), F.lit("ss")))
    cache = rows.where("turn = 0").select(F.col("text").alias("sentence"), F.lit("cached").alias("translated_text"), F.lit("nl").alias("source_language"), F.lit("en").alias("target_language")).distinct()
    return M.translate_cached(rows, cache, "text", "nl", "en", M.ModelSettings(instructions=("upper",))).select("conv_id", "turn", "translated_text")


@query("glossary_translation", "SELECT item_id, replace(upper(text), 'THE', 'de') AS text FROM (SELECT item_id, replace(replace(replace(text, 'ß', 'ss'), 'The', 'xx'), 'THE', 'xx') AS text FROM benchmark)")
def glossary_translation(t: Tables) -> DataFrame:
    rows = t.benchmark.withColumn("text", F.replace(F.replace(F.replace("text", F.lit("ß"), F.lit("ss")), F.lit("The"), F.lit("xx")), F.lit("THE"), F.lit("xx")))
    return rows.select("item_id", M.translate_with_glossary(F.col("text"), {"the": "de"}).alias("text"))


@query("relevance_scores")
def relevance_scores(t: Tables) -> DataFrame:
    model = M.fit_relevance(t.documents, t.labels)
    return M.score_relevance(model, t.documents).select("doc_id", F.round("score", 4).alias("score"))


@query("word_embeddings")
def word_embeddings(t: Tables) -> DataFrame:
    """Word vectors borrowed from the table of embeddings; misspelt words find theirs."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    numbered = words.select("w", (F.pmod(F.xxhash64("w"), F.lit(200))).alias("vec_id"))
    vectors = numbered.join(t.embeddings, "vec_id").select("w", "embedding")
    tokens = t.part.select("p_partkey", F.explode(F.split(F.concat("p_name", F.lit("x")), " ")).alias("w"))
    return M.embed_words(tokens, vectors, "p_partkey", "w", "embedding")


@query("reduced_vectors")
def reduced_vectors(t: Tables) -> DataFrame:
    out = M.reduce_dimensions(t.embeddings, "embedding", 4)
    return out.select("vec_id", F.transform("reduced", lambda x: F.round(x, 4)).alias("reduced"))


# --- streams ---------------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster shares; our own only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="siftline-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(t: Tables, name: str) -> DataFrame:
    from ..streaming.stages import read_stream

    return read_stream(t.spark, f"{t.sf_dir}/{name}.parque[t]", getattr(t, name).schema)


@query("stream_dedup", "SELECT count(DISTINCT text) AS texts, count(DISTINCT text) AS n FROM documents")
def stream_dedup(t: Tables) -> DataFrame:
    from ..streaming.stages import dedup_stream, write_stream

    at = scratch(t.spark)
    write_stream(dedup_stream(_stream(t, "documents")), f"{at}/out", f"{at}/state").awaitTermination()
    return t.spark.read.parquet(f"{at}/out").agg(F.countDistinct("text").alias("texts"), F.count("*").alias("n"))


@query("stream_clean", "SELECT doc_id, regexp_replace(text, '[0-9]', '#', 'g') AS text FROM documents")
def stream_clean(t: Tables) -> DataFrame:
    from ..streaming.stages import run_batches

    at = scratch(t.spark)
    run_batches(_stream(t, "documents"), f"{at}/out", f"{at}/state", lambda d: d.select("doc_id", F.regexp_replace("text", "[0-9]", "#").alias("text")), key="doc_id").awaitTermination()
    return t.spark.read.parquet(f"{at}/out")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(t: Tables) -> DataFrame:
    from ..streaming.stages import window_counts

    name = f"windows_{uuid.uuid4().hex}"
    q = window_counts(_stream(t, "events"), "ts", "event_type", "value").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", scratch(t.spark)).start().awaitTermination()
    return t.spark.table(name)


@query("stream_split")
def stream_split(t: Tables) -> DataFrame:
    from ..streaming.stages import split_stream, write_stream

    at = scratch(t.spark)
    write_stream(split_stream(_stream(t, "documents"), "doc_id", "text", 1000), f"{at}/out", f"{at}/state").awaitTermination()
    return t.spark.read.parquet(f"{at}/out")
