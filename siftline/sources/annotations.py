"""Scans of annotation formats: title/abstract/mention files, stand-off lines, span tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spans import collect_spans
from .files import file_stem

ALLOWED = {("START", "title"), ("title", "abstract"), ("abstract", "mention"), ("abstract", "blank"), ("abstract", "title"), ("mention", "mention"), ("mention", "blank"), ("mention", "title"), ("blank", "title"), ("blank", "blank")}


def line_kind(line: Column) -> Column:
    """blank, title, abstract, mention or unknown; a mention has six cells, the first three numbers."""
    mention = line.rlike(r"^[0-9]{1,18}\t[0-9]{1,9}\t[0-9]{1,9}\t") & (F.size(F.split(line, "\t", -1)) == 6)
    return F.when(F.trim(line) == "", "blank").when(line.rlike(r"^[0-9]{1,18}\|t\|"), "title").when(line.rlike(r"^[0-9]{1,18}\|a\|"), "abstract").when(mention, "mention").otherwise("unknown")


def pubtator_lines(df: DataFrame) -> DataFrame:
    """(file, pos, line, kind, before) of (file, text)."""
    rows = df.select("file", F.posexplode(F.split(F.regexp_replace("text", "\n+$", ""), "\n", -1)).alias("pos", "line")).withColumn("kind", line_kind(F.col("line")))
    return rows.withColumn("before", F.coalesce(F.lag("kind").over(Window.partitionBy("file").orderBy("pos")), F.lit("START")))


def pubtator_errors(df: DataFrame) -> DataFrame:
    """Lines of no known kind or where their kind may not stand."""
    return pubtator_lines(df).where(~F.concat_ws(">", "before", "kind").isin([f"{a}>{b}" for a, b in sorted(ALLOWED)]))


def pubtator(df: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(id, title, text, tags) of (file, text): tags are (start, end, text, tag, cui) in order; ``groups`` (tui, group) names semantic types."""
    rows = pubtator_lines(df)
    head, cells = F.split("line", "\\|", 3), F.split("line", "\t", -1)
    key = F.when(F.col("kind") == "mention", cells[0]).otherwise(head[0]).cast("long")
    parts = rows.where(F.col("kind").isin("title", "abstract", "mention")).select(
        key.alias("id"), F.when(F.col("kind") == "title", head[2]).alias("title"), F.when(F.col("kind") == "abstract", head[2]).alias("abstract"),
        F.when(F.col("kind") == "mention", F.struct(cells[1].cast("int").alias("start"), cells[2].cast("int").alias("end"), cells[3].alias("text"), cells[4].alias("tag"), cells[5].alias("cui"))).alias("m"),
    )
    docs = parts.groupBy("id").agg(F.max("title").alias("title"), F.max("abstract").alias("abstract"), F.array_sort(F.collect_list("m")).alias("tags"))
    docs = docs.select("id", "title", F.concat_ws(" ", "title", "abstract").alias("text"), "tags")
    if groups is None:
        return docs
    flat = docs.select("id", F.explode("tags").alias("m")).select("id", "m.*").join(groups.select(F.col("tui").alias("tag"), "group"), "tag", "left").withColumn("group", F.coalesce("group", F.lit("Unknown")))
    named = flat.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", F.col("group").alias("tag"), "cui"))).alias("named"))
    return docs.join(named, "id", "left").select("id", "title", "text", F.coalesce("named", "tags").alias("tags"))


def standoff_spans(line: Column) -> Column:
    """A struct (start, end, tag, text) from a line ``Tn TAB tag start end TAB surface``; null for other lines and broken-up spans."""
    cells = F.split(line, "\t", -1)
    what = F.split(cells[1], " ")
    fine = line.rlike(r"^T[0-9]+\t\S+ [0-9]+ [0-9]+\t")
    return F.when(fine, F.struct(what[1].cast("int").alias("start"), what[2].cast("int").alias("end"), what[0].alias("tag"), cells[2].alias("text")))


def ner_records(spans: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """(id, text, tags): spans of each document with its text."""
    return collect_spans(spans, key).join(texts.select(key, "text"), key).select(key, "text", "tags")


def read_standoff(spark: SparkSession, ann: str, txt: str) -> DataFrame:
    """NER records from folders of .ann and .txt files, matched by name."""
    lines = spark.read.text(f"{ann}/*.ann").select(file_stem(F.input_file_name()).alias("id"), standoff_spans(F.col("value")).alias("s")).where("s IS NOT NULL")
    texts = spark.read.text(f"{txt}/*.txt", wholetext=True).select(file_stem(F.input_file_name()).alias("id"), F.col("value").alias("text"))
    return ner_records(lines.select("id", "s.*"), texts)


def read_span_table(spark: SparkSession, path: str, txt: str, names: dict[str, str] | None = None) -> DataFrame:
    """NER records from a tab-separated table with a header and a folder of .txt files."""
    names = names or {"name": "id", "tag": "tag", "start_span": "start", "end_span": "end"}
    rows = spark.read.options(header="true", sep="\t").csv(path).select(*[F.col(a).alias(b) for a, b in names.items()])
    texts = spark.read.text(f"{txt}/*.txt", wholetext=True).select(file_stem(F.input_file_name()).alias("id"), F.col("value").alias("text"))
    return ner_records(rows, texts)
