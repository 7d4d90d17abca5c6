"""Splitting documents into chunks. Greedy packers are folds over one document, so they run in Arrow batches; fixed chunks are expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import each
from ..functions.text import let, words_ws

_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)")


def pack(parts: list[str], size: Callable[[str], int], most: int, joiner: str = " ", glue: int = 0) -> list[str]:
    """Greedy packing in order: a chunk is closed before it would exceed ``most``; a part that is too large stands alone."""
    out, held, total = [], [], 0
    for part in parts:
        n = size(part)
        if held and total + n + glue > most:
            out.append(joiner.join(held))
            held, total = [], 0
        total += n + (glue if held else 0)
        held.append(part)
    return [*out, joiner.join(held)] if held else out


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.strip()) if s]


def word_count(text: str) -> int:
    return len(text.split())


def _chunker(split: Callable[[str], list[str]], size: Callable[[str], int], most: int, joiner: str, glue: int = 0):
    return each(lambda t: pack(split(t), size, most, joiner, glue), "array<string>")


def chunk(df: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    """(id, chunk, text): one row a chunk, numbered from 0."""
    return df.select(id_col, F.posexplode(chunks).alias("chunk", "text"))


def paragraph_chunks(text: Column, most: int = 512) -> Column:
    """Paragraphs packed up to a number of words."""
    return _chunker(lambda t: [p.strip() for p in re.split(r"\n+", t) if p.strip()], word_count, most, " ")(text)


def sentence_chunks(text: Column, most: int = 256) -> Column:
    """Sentences packed up to a number of words."""
    return _chunker(sentences, word_count, most, " ")(text)


def char_chunks(text: Column, most: int = 5000) -> Column:
    """Words packed up to a number of characters, blanks counted; never an empty chunk."""
    return _chunker(str.split, len, most, " ", 1)(text)


def separated_chunks(text: Column, most: int = 5000) -> Column:
    """Paragraphs with the separators between them packed up to a number of characters; joined, the chunks give the text."""
    return _chunker(lambda t: re.findall(r"\n+|[^\n]+", t), len, most, "")(text)


def token_chunks(text: Column, most: int = 512, count: Callable[[str], int] = word_count) -> Column:
    """Sentences packed up to a number of tokens by any counter; a sentence that alone is too long is split at words."""

    def split(t: str) -> list[str]:
        out: list[str] = []
        for s in sentences(t):
            out += [s] if count(s) <= most else pack(s.split(), count, most)
        return out

    return _chunker(split, count, most, " ")(text)


def word_chunks(text: Column, n: int) -> Column:
    """Chunks of exactly ``n`` words, the last one shorter."""

    def cut(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / n).cast("int")), lambda i: F.array_join(F.slice(words, i * n + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words_ws(text), cut)


def majority_vote(df: DataFrame, id_col: str, text: str, n: int, vote: Callable[[Column], Column]) -> DataFrame:
    """(id, relevant): whether most of a document's word chunks are voted for."""
    rows = chunk(df, id_col, word_chunks(F.col(text), n))
    return rows.groupBy(id_col).agg((F.avg(vote(F.col("text")).cast("double")) > 0.5).alias("relevant"))


def split_by_marker(df: DataFrame, by: str, pos: str, text: str, marker: str) -> DataFrame:
    """(by, part, tag, text): lines cut into documents; a line that matches ends its document and gives the tag."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_hit", F.col(text).rlike(marker).cast("int")).withColumn("part", F.coalesce(F.sum("_hit").over(w), F.lit(0)).cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, F.col(text).alias("_t")))), lambda r: r["_t"]), "\n")
    tag = F.max(F.when(F.col("_hit") == 1, F.substring(F.regexp_replace(F.regexp_extract(text, f"({marker})", 1), "[^a-zA-Z0-9]", ""), 1, 20)))
    return rows.groupBy(by, "part").agg(tag.alias("tag"), joined.alias(text))


def split_by_bytes(text: Column, most: int, marker: str | None = None) -> Column:
    """Lines packed into documents of at most ``most`` bytes; a line that matches ``marker`` ends its document at once."""
    hit = re.compile(marker) if marker else None

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            docs, held, size = [], [], 0
            for line in (t or "").split("\n"):
                held.append(line)
                size += len(line.encode()) + 1
                if size >= most or (hit and hit.search(line)):
                    docs.append("\n".join(held))
                    held, size = [], 0
            out.append(docs + ["\n".join(held)] if held else docs)
        return pd.Series(out)

    return run(text)
