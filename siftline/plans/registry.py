"""Registration of queries with their DuckDB SQL, and writers of SQL for rule folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables; without SQL, tests hold it against brute force."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fold(expression: str, rules: Sequence[tuple[str, str]]) -> str:
    for pattern, new in rules:
        new = new.replace("$1", "\\1")
        expression = f"regexp_replace({expression}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return expression


def sql_any(expression: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({expression}, {quoted(t)})" for t in terms) + ")"


LINES = "string_split(text, chr(10))"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
NONWORD = r"regexp_split_to_array(text, '[^\p{L}\p{N}_]')"


def words_of(expression: str) -> str:
    return rf"list_filter(regexp_split_to_array({expression}, '\s+'), lambda w: w <> '')"
