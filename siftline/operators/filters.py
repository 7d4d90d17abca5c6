"""Row filters and the columns they rest on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import clean_page, lines, words_space, words_ws


def any_of(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term occurs as a substring; false for an empty list."""
    return reduce(lambda a, t: a | F.contains(text, F.lit(t)), terms, F.lit(False))


def term_relevant(text: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), conservative: bool = True) -> Column:
    """Conservative: some included term and no excluded one. Otherwise: no excluded one."""
    include, exclude = include or R.INCLUDE_TERMS, exclude or R.EXCLUDE_TERMS
    fine = ~any_of(text, exclude)
    return any_of(text, include) & fine if conservative else fine


def model_relevant(term: Column, score: Column, threshold: float = 0.5, greedy: bool = False, outcome: bool = True) -> Column:
    """Terms and a model's score together; ``greedy`` takes either. ``outcome`` False turns the score over."""
    s = score if outcome else 1 - score
    passed = s >= threshold
    return (term | passed) if greedy else (term & passed)


def min_words(text: Column, n: int = 64) -> Column:
    return F.size(words_ws(text)) >= n


def first_words(text: Column, n: int) -> Column:
    """Texts of more than ``n`` characters are cut to their first ``n`` words."""
    return F.when(F.length(text) > n, F.array_join(F.slice(words_space(text), 1, n), " ")).otherwise(text)


def count_phrase(text: Column, phrase: str) -> Column:
    return F.size(F.split(text, "\\Q" + phrase + "\\E", -1)) - 1


def page_is_body(text: Column, least: int = 50, least_after: int = 25) -> Column:
    """Pages of running text: long enough before and after cleaning, no front or back matter, fewer than two chapter heads."""
    low = F.lower(text)
    bare = [~any_of(low, phrases) for phrases in R.PAGE_PHRASES.values()]
    heads = count_phrase(low, "chapter ") + count_phrase(low, "hoofdstuk ")
    return reduce(lambda a, b: a & b, bare, (F.size(words_ws(text)) > least) & (heads < 2) & (F.size(words_ws(clean_page(text))) > least_after))


def long_lines(text: Column, words: int = 10) -> Column:
    """How many lines have more than ``words`` words."""
    return F.size(F.filter(lines(text), lambda x: F.size(words_space(x)) > words))


def exclude_values(df: DataFrame, values: dict[str, Sequence]) -> DataFrame:
    """Rows whose columns have none of the listed values; null stays."""
    return df.where(reduce(lambda a, kv: a & ~F.coalesce(F.col(kv[0]).isin(list(kv[1])), F.lit(False)), values.items(), F.lit(True)))


def atc_valid(code: Column) -> Column:
    """Whether a drug code has the shape of one of the levels."""
    return code.rlike("^[A-Z](?:[^a-z][0-9]{1,2}(?:[A-Z]{1,2}(?:[0-9]{1,2})?)?)?$")


def keyword_lookup(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", term_col: str = "term", most_words: int = 4) -> DataFrame:
    """(id, term, n): whole-word matches of many terms by an equi-join of the words' n-grams; a term has at most ``most_words`` words."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(id_col, words.alias("w"))
    grams = F.flatten(
        F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(F.array().cast("array<string>")))
    )
    hits = rows.select(id_col, F.explode(grams).alias("gram"))
    wanted = terms.select(F.lower(F.col(term_col)).alias("gram"), F.col(term_col)).distinct()
    return hits.join(wanted, "gram").groupBy(id_col, term_col).agg(F.count("*").alias("n"))


def foreign_share(lines_df: DataFrame, id_col: str, lang_col: str, target: str, most: float = 0.5) -> DataFrame:
    """Ids of documents of whose lines at most ``most`` are in another language."""
    share = F.avg((F.col(lang_col) != target).cast("double"))
    return lines_df.groupBy(id_col).agg(share.alias("foreign")).where(F.col("foreign") <= most)


def record_relevant(subject: Column, fmt: Column, kind: Column, rights: Column, topics: Sequence[str]) -> Column:
    """Catalogue records on a topic, in PDF, of doctoral level and not under embargo; every argument is an array."""
    has = lambda c, words: F.exists(c, lambda x: any_of(F.lower(x), words))
    return has(subject, list(topics)) & has(fmt, ["pdf"]) & has(kind, ["doctor"]) & ~F.coalesce(has(rights, ["embargo"]), F.lit(False))


def links_matching(links: Column, patterns: Sequence[str], ending: str = ".pdf") -> Column:
    """Of an array of links those that match a pattern or end as wanted."""
    return F.filter(links, lambda x: F.lower(x).startswith("http") & reduce(lambda a, p: a | x.rlike(p), patterns, F.lower(x).endswith(ending)))
