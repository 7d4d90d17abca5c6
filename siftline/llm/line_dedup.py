"""Line dedup with overlapping windows of consecutive lines.

Every run of ``window`` lines (three) is hashed; a hash that occurs more than once
in the corpus keeps its first occurrence, ordered by id, then text digest, then
line; the lines under every later occurrence go. Windows overlap, so the removed
positions are the union of the later windows.

Only (hash, id, digest, position) rows are shuffled to find repeats. A hot window
costs no more than any other: its rows are combined map-side for the first
occurrence, and the join back is left to adaptive skew handling.

Defined results
---------------
* null or empty text, or fewer than ``window`` lines: the row stays as it is.
* a document that loses every line is dropped; any other keeps its remaining lines joined by newlines.
* ties: rows with the same id and text are one document and get the same result; the same id with other text is another document, ordered by its digest.
* a null id sorts before all others. An empty table gives an empty table.
* other columns pass through, whatever their names; ``length_col``, if given and present, is set to the new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, durable, fresh, require


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, length_col: str | None = None) -> DataFrame:
    """Documents without the later occurrences of repeated ``window``-line runs; see the module's text."""
    require(docs, id_col, text_col)
    key, digest = fresh(["start", "starts", "win", "head", "seen"], "id", "digest")
    lines = F.split(col(text_col), "\n", -1)
    runs = F.when(
        F.size(lines) >= window,
        F.transform(F.sequence(F.lit(0), F.size(lines) - window), lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice(lines, i + 1, window))))),
    )
    windows = durable(
        docs.where(col(text_col).isNotNull())
        .select(col(id_col).alias(key), F.xxhash64(col(text_col)).alias(digest), F.posexplode(runs).alias("start", "win"))
    )
    here = F.struct(key, digest, "start")
    heads = windows.groupBy("win").agg(F.min(here).alias("head"), F.count("*").alias("seen")).where("seen > 1").drop("seen")
    later = windows.join(heads, "win").where(~here.eqNullSafe(F.col("head")))
    covered = later.groupBy(key, digest).agg(F.sort_array(F.collect_set("start")).alias("starts"))

    mine, starts, parts, other = fresh(docs, "digest", "starts", "lines", "other_id")
    covered = covered.select(F.col(key).alias(other), F.col(digest).alias(mine + "_2"), F.col("starts").alias(starts))
    joined = docs.withColumn(mine, F.xxhash64(col(text_col))).join(covered, col(id_col).eqNullSafe(F.col(other)) & (F.col(mine) == F.col(mine + "_2")), "left")
    joined = joined.withColumn(parts, F.when(F.col(starts).isNotNull(), lines))
    m = F.size(starts)
    gaps = F.transform(
        F.sequence(F.lit(0), m),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get(starts, i - 1) + window).alias("a"),
            F.when(i == m, F.size(parts)).otherwise(F.get(starts, i)).alias("b"),
        ),
    )
    kept = F.flatten(F.transform(F.filter(gaps, lambda g: g.b > g.a), lambda g: F.slice(F.col(parts), g.a + 1, g.b - g.a)))
    joined = joined.withColumn(parts, F.when(F.col(starts).isNotNull(), kept))
    text = F.when(F.col(starts).isNull(), col(text_col)).otherwise(F.array_join(parts, "\n"))
    out = joined.where(F.col(starts).isNull() | (F.size(parts) > 0)).withColumn(text_col, text)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(col(text_col)).cast(docs.schema[length_col].dataType))
    return out.select(*[col(c) for c in docs.columns])
