"""Front to back of scanned theses: which pages hold the summary, which hold running text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import page_is_body
from ..functions.text import clean_page

_DUTCH = ("samenvatting", "dutch summary")
_ENGLISH = ("summary", "summery")
_OTHER = ("dankwoord", "nawoord", "acknowledg", "contents", "list of figures", "list of abbreviations", "references")
_SECTION = re.compile(r"^\d+\n(\d*)")
_NUMBER_LINES = re.compile(r"\d+\n\d*")


def _says(page: str, phrases: tuple[str, ...]) -> bool:
    """Whether a phrase stands in the first or last 60 characters, perhaps with its first letter set apart."""
    low = page.lower()
    ends = (low[:60], low[-60:])
    return any(p in e or f"{p[0]} {p[1:]}" in e for p in phrases for e in ends)


def capture(pages: list[str], start: tuple[str, ...], stop: tuple[str, ...], most: int = 20) -> list[str]:
    """Pages from one that says a starting phrase until one that says a stopping phrase or opens another section."""
    out, on, section, seen = [], False, None, 0
    for page in pages:
        here = _SECTION.findall(page)
        page = _NUMBER_LINES.sub("", page)
        if _says(page, start):
            on, section, seen = True, here, seen + 1
        elif _says(page, stop) or here != section:
            on = False
        if on:
            out.append(page)
            seen += 1
        if seen >= most:
            break
    return out


def summaries(df: DataFrame, key: str = "file", page: str = "pseudo_pagenum", text: str = "text") -> DataFrame:
    """(key, summary_english, summary_dutch) from the pages of each file."""
    rows = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda r: r[text]).alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(capture(list(p), _ENGLISH, (*_OTHER, *_DUTCH)), capture(list(p), _DUTCH, (*_OTHER, "english summary"))) for p in pdf["pages"]]
            yield pd.DataFrame({key: pdf[key], "summary_english": ["\n".join(g[0]) for g in got], "summary_dutch": ["\n".join(g[1]) for g in got]})

    return rows.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, summary_english string, summary_dutch string")


def body_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """Pages of running text, cleaned."""
    return df.where(page_is_body(F.col(text))).withColumn(text, clean_page(F.col(text)))


def is_scan(df: DataFrame, key: str, text: str, producer: str | None = None, empty_share: float = 0.5) -> DataFrame:
    """(key, scanned): files made by a scanner or of mostly empty pages."""
    empty = F.avg((F.length(F.trim(F.coalesce(text, F.lit("")))) == 0).cast("double")) > empty_share
    made = F.coalesce(F.max(F.lower(F.col(producer)).rlike("scan|xerox|ricoh|canon|konica")), F.lit(False)) if producer else F.lit(False)
    return df.groupBy(key).agg((empty | made).alias("scanned"))
