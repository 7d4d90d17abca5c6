"""Annotated spans: injection into text, overlaps, tags for tokens, exchange formats."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines

SPAN = "struct<start:int,end:int,text:string,tag:string,cui:string>"
_TOKEN = re.compile(r"\w+|[^\w\s]")


def span_length(span: Column) -> Column:
    return span["end"] - span["start"]


def title_and_abstract(title: Column, abstract: Column) -> Column:
    """Both with one blank between, the base of span offsets; an error if either is missing."""
    return F.when(title.isNull() | abstract.isNull(), F.raise_error(F.lit("title and abstract are both needed"))).otherwise(F.concat_ws(" ", title, abstract))


def inject(text: Column, spans: Column) -> Column:
    """Spans that don't overlap become ``[[surface][cui]]``."""

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("[["), F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit("]["), s["cui"], F.lit("]]"))
        return F.struct(F.concat(acc["out"], piece, mark).alias("out"), s["end"].alias("at"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["cui"].alias("cui"))))
    return F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def resolve(spans: list[dict], longest: bool = True) -> list[dict]:
    """Of overlapping spans (closed intervals) one stays, the longest or the shortest; ties keep the earlier."""
    out: list[dict] = []
    size = lambda s: s["end"] - s["start"]
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and out[-1]["end"] >= s["start"]:
            better = size(s) > size(out[-1]) if longest else size(s) < size(out[-1])
            if better:
                out[-1] = s
        else:
            out.append(s)
    return out


def resolve_overlaps(spans: Column, longest: bool = True) -> Column:
    @F.pandas_udf(f"array<{SPAN}>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else resolve([dict(s) for s in x], longest))

    return run(spans)


def biluo(text: str, spans: list[dict], key: str) -> list[tuple[str, str]]:
    """(token, tag) pairs; a span that cuts a token gives ``-`` to the tokens that it touches."""
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    tags = ["O"] * len(tokens)
    for s in spans:
        inside = [i for i, (a, b, _) in enumerate(tokens) if a < s["end"] and b > s["start"]]
        if not inside:
            continue
        if tokens[inside[0]][0] != s["start"] or tokens[inside[-1]][1] != s["end"]:
            marks = ["-"] * len(inside)
        elif len(inside) == 1:
            marks = [f"U-{s[key]}"]
        else:
            marks = [f"B-{s[key]}", *[f"I-{s[key]}"] * (len(inside) - 2), f"L-{s[key]}"]
        for i, mark in zip(inside, marks):
            tags[i] = mark
    return [(t[2], tag) for t, tag in zip(tokens, tags)]


def token_tags(text: Column, spans: Column) -> Column:
    """Tokens with two layers of tags, by type and by concept, and marks at the ends of sentences."""

    @F.pandas_udf("array<struct<token:string,tag:string,concept:string>>")
    def run(texts: pd.Series, batch: pd.Series) -> pd.Series:
        out = []
        for t, given in zip(texts, batch):
            kept = resolve([dict(s) for s in (given if given is not None else [])])
            rows, open_ = [], False
            for (token, a), (_, b) in zip(biluo(t or "", kept, "tag"), biluo(t or "", kept, "cui")):
                if not open_:
                    rows.append({"token": "<START>", "tag": "<START>", "concept": "<START>"})
                    open_ = True
                rows.append({"token": token, "tag": a, "concept": b})
                if token in ".!?":
                    rows.append({"token": "<END>", "tag": "<END>", "concept": "<END>"})
                    open_ = False
            if open_:
                rows.append({"token": "<END>", "tag": "<END>", "concept": "<END>"})
            out.append(rows)
        return pd.Series(out)

    return run(text, spans)


def collect_spans(df: DataFrame, key: str, start: str = "start", end: str = "end", tag: str = "tag") -> DataFrame:
    """(key, tags): spans of each document in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("int").alias("start"), F.col(end).cast("int").alias("end"), F.col(tag).alias("tag")))).alias("tags"))


def to_brat(df: DataFrame, key: str = "id", tags: str = "tags", text: str = "text") -> DataFrame:
    """(key, line): stand-off lines ``Tn TAB tag start end TAB surface``."""
    rows = df.select(key, text, F.posexplode(tags).alias("n", "t"))
    surface = F.substring(F.col(text), F.col("t.start") + 1, F.col("t.end") - F.col("t.start"))
    return rows.select(key, "n", F.format_string("T%d\t%s %d %d\t%s", F.col("n") + 1, F.col("t.tag"), F.col("t.start"), F.col("t.end"), surface).alias("line"))


def to_table(df: DataFrame, key: str = "id", tags: str = "tags", text: str = "text") -> DataFrame:
    """One row a span with the columns of the tabular exchange format."""
    rows = df.select(F.col(key).alias("name"), F.col(text).alias("_t"), F.explode(tags).alias("t"))
    return rows.select("name", F.col("t.tag").alias("tag"), F.col("t.start").alias("start_span"), F.col("t.end").alias("end_span"), F.substring(F.col("_t"), F.col("t.start") + 1, F.col("t.end") - F.col("t.start")).alias("text"), F.lit("").alias("comment"))


def merge_annotations(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, text): annotation files of several classes put together in order, blank lines left out."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("_t")))), lambda r: r["_t"])
    return df.groupBy(key).agg(F.array_join(F.filter(lines(F.array_join(rows, "\n")), lambda x: F.trim(x) != ""), "\n").alias(text))
