"""Sinks: resumable appends, flattened Parquet, splits, cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.relational import not_done

#: Rows of a labelling run.
LABEL_SCHEMA = T.StructType(
    [T.StructField("k", T.LongType()), T.StructField("id", T.LongType()), T.StructField("success", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in ("text", "inferred_label", "model", "instructions", "meta")]
    + [T.StructField(c, T.DoubleType()) for c in ("proba", "logprob")]
)


def written(df: DataFrame, path: str, kind: str) -> DataFrame | None:
    """What a sink holds, or None if it isn't there yet; one that can't be read is an error."""
    try:
        return df.sparkSession.read.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_missing(df: DataFrame, path: str, key: str = "id", kind: str = "json", error: str | None = "error_message", transform: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Append the rows whose key the sink lacks (rows with an error count as lacking), after ``transform``; how many were missing."""
    done = written(df, path, kind)
    rows = df if done is None or key not in done.columns else not_done(df, done, key, error)
    n = rows.count()
    if n:
        (transform(rows) if transform else rows).write.mode("append").format(kind).save(path)
    return n


def flatten(df: DataFrame, joiner: str = "_") -> DataFrame:
    """Nested structs as columns named parent_child."""

    def walk(schema: T.StructType, at: Column | None, names: list[str]) -> list[Column]:
        out = []
        for f in schema:
            here = F.col(f"`{f.name}`") if at is None else at[f.name]
            path = [*names, f.name]
            out += walk(f.dataType, here, path) if isinstance(f.dataType, T.StructType) else [here.alias(joiner.join(path))]
        return out

    return df.select(*walk(df.schema, None, []))


def write_flat(df: DataFrame, path: str, rows_per_file: int = 32_000) -> None:
    flatten(df).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").parquet(path)


def write_labels(df: DataFrame, path: str) -> None:
    """Append with the fixed schema."""
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LABEL_SCHEMA]).write.mode("append").option("compression", "snappy").parquet(path)


def write_splits(df: DataFrame, path: str, by: str = "split", kind: str = "json") -> None:
    """A folder for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).format(kind).save(path)


def write_text(df: DataFrame, path: str, column: str = "text", encoding: str = "UTF-8") -> None:
    """Text lines. Other encodings go through the csv writer without quotes."""
    if encoding.upper() == "UTF-8":
        df.select(column).write.mode("overwrite").text(path)
    else:
        df.select(column).write.mode("overwrite").options(quote="", sep="\u0001", encoding=encoding, header="false", escape="").csv(path)


def line_parts(df: DataFrame, line: str, n: int) -> DataFrame:
    """``part``: every ``n`` lines are one part file."""
    return df.withColumn("part", F.floor(F.col(line) / n))


CARD = """---
language: [{languages}]
size_category: {size}
---
# {name}

{description}

| documents | words | sources |
|---|---|---|
| {documents} | {words} | {sources} |
"""


def dataset_card(df: DataFrame, name: str, description: str, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row with the card of a data set, all figures from one pass."""
    from ..functions.text import words_ws

    facts = df.agg(F.count("*").alias("documents"), F.sum(F.size(words_ws(F.col(text)))).alias("words"), F.countDistinct(source).alias("sources"), F.array_join(F.array_sort(F.collect_set(lang)), ", ").alias("languages"))
    size = F.when(F.col("documents") < 1000, "n<1K").when(F.col("documents") < 100_000, "1K<n<100K").otherwise("n>100K")
    card = F.lit(CARD.replace("{name}", name).replace("{description}", description))
    for field, value in (("languages", F.col("languages")), ("size", size), ("documents", F.col("documents").cast("string")), ("words", F.col("words").cast("string")), ("sources", F.col("sources").cast("string"))):
        card = F.replace(card, F.lit("{" + field + "}"), value)
    return facts.select(card.alias("card"))
