"""Exact dedup by skew-safe combining.

Three stages, each grouping on the digest *and* the whole text, so that two texts
with one digest never merge:

1. local: rows are combined inside their input partition (the partial side of stage 2's grouping);
2. salted: groups of (digest, salt, text) are merged, ``salts`` of them to a digest, so that one hot text is spread over many tasks;
3. global: the at most ``salts`` winners of a digest are combined to one.

A hot text reaches stage 3 as at most ``salts`` rows, however many copies it has.

Defined results
---------------
* the winner is the copy with the smallest id; a null id sorts after all others; equal ids are decided by the other columns' JSON.
* null texts are one group, empty texts another; each keeps one row.
* every column of the winner is kept; ``copies`` (renamed if it clashes) counts the rows of its group.
* an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, other_columns_hash, require


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row of each distinct text with its number of copies; see the module's text."""
    require(docs, id_col, text_col)
    copies = fresh(docs, "copies")[0]
    rest = [c for c in docs.columns if c != text_col]
    text = fresh(["digest", "salt", "row", "rank", "n"], text_col)[0]
    rows = docs.select(
        F.xxhash64(col(text_col)).alias("digest"),
        F.pmod(F.xxhash64(col(id_col), F.lit(17)), F.lit(salts)).cast("int").alias("salt"),
        col(text_col).alias(text),
        F.struct(*[col(c) for c in rest]).alias("row"),
        F.struct(col(id_col).isNull().alias("no_id"), col(id_col).alias("id"), other_columns_hash(docs, id_col, text_col).alias("json")).alias("rank"),
    )
    salted = rows.groupBy("digest", "salt", text).agg(F.min_by("row", "rank").alias("row"), F.min("rank").alias("rank"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", text).agg(F.min_by("row", "rank").alias("row"), F.sum("n").alias("n"))
    named = {c: F.col("row").getField(c) for c in rest}
    return whole.select(*[(F.col(text) if c == text_col else named[c]).alias(c) for c in docs.columns], F.col("n").alias(copies))
