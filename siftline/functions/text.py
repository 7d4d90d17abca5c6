"""Column functions for text: rule folds, tokenisers, line filters, cleaning chains, hashes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

Rules = Sequence[tuple[str, str]]


def fold(text: Column, rules: Rules) -> Column:
    """Apply every (pattern, replacement) in turn."""
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def replace_literals(text: Column, rules: Rules) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


# --- tokenisers: four definitions of a word, kept apart ---------------------------------------


def words_nonword(text: Column) -> Column:
    """Split at every character that is no letter, digit or underscore; empties stay."""
    return F.split(text, r"[^\p{L}\p{N}_]", -1)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it inside lambdas."""
    return F.transform(F.array(value), fn)[0]


def words_ws(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def words_space(text: Column) -> Column:
    """Split at single blanks; empties stay."""
    return F.split(text, " ", -1)


def words_nonspace(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def map_lines(text: Column, fn: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(lines(text), fn), "\n")


def keep_lines(text: Column, keep: Callable[[Column], Column]) -> Column:
    return F.array_join(F.filter(lines(text), keep), "\n")


# --- cleaning ----------------------------------------------------------------------------------


def fix_mojibake(text: Column) -> Column:
    return replace_literals(text, R.MOJIBAKE)


def fix_encoding(text: Column) -> Column:
    """Undo UTF-8 read as Latin-1 where the whole text survives the round trip."""
    narrow = text.rlike(r"[Â-ô][\u0080-¿]") & ~text.rlike(r"[^\u0000-ÿ]")
    bytes_ = F.when(narrow, F.encode(text, "ISO-8859-1"))
    return F.coalesce(F.when(F.is_valid_utf8(bytes_.cast("string")), bytes_.cast("string")), text)


def normalize_sections(text: Column, most: int = 3) -> Column:
    """Shift header depths so that the least is one, and cap them."""
    marks = F.regexp_extract_all(text, F.lit("(\n#+)"), F.lit(1))
    least = F.array_min(F.transform(marks, lambda m: F.length(m) - 1))
    lifted = F.regexp_replace(text, F.concat(F.lit("\n#{"), least.cast("string"), F.lit("}")), F.lit("\n#"))
    capped = F.regexp_replace(lifted, F.lit("\n#{%d,}" % most), F.lit("\n" + "#" * most))
    return F.when(F.contains(text, F.lit("\n#")), capped).otherwise(text)


def normalize_newlines(text: Column) -> Column:
    """Drop lines without ASCII letters, collapse breaks, put a blank line before headers."""
    kept = F.filter(lines(text), lambda x: x.rlike("[a-zA-Z]"))
    joined = F.concat(F.array_join(kept, "\n"), F.when(F.size(kept) > 0, F.lit("\n")).otherwise(F.lit("")))
    return fold(joined, [(r"\n\s*\n", "\n"), ("\n#", "\n\n#")])


def clean(text: Column, parity: bool = False) -> Column:
    """The common chain: links, references, lists, glyphs, sections, newlines, strip."""
    text = fold(text, [*R.URLS, *R.REFERENCES, *(R.LISTS_PARITY if parity else R.LISTS), *R.GLYPHS])
    return F.trim(fold(normalize_newlines(normalize_sections(text)), [(r"^\s+", ""), (r"\s+$", "")]))


def squeeze_lines(text: Column, min_chars: int = 20) -> Column:
    """Squeeze blanks and mask numbers in each line; keep lines longer than ``min_chars``."""
    cleaned = F.transform(lines(text), lambda x: F.trim(fold(x, [(r"\s+", " "), ("[0-9]+", "#")])))
    return F.array_join(F.filter(cleaned, lambda x: F.length(x) > min_chars), "\n")


def clean_pmc(text: Column) -> Column:
    return F.trim(fold(text, R.PMC_TAGS))


def clean_summary(text: Column) -> Column:
    """Remove headings' words and leading markers, squeeze, keep lines of more than three words."""
    first, spaces, tabs, lead = R.SUMMARY
    strip = [(r"^\s+", ""), (r"\s+$", "")]
    return keep_lines(fold(text, [first, *strip, spaces, tabs, lead, *strip]), lambda x: F.size(words_ws(x)) > 3)


def clean_page(text: Column) -> Column:
    return fold(text, R.PAGE)


def csv_summary(text: Column) -> Column:
    """A summary as a quoted field."""
    return F.concat(F.lit('"'), F.translate(F.translate(text, "\r\n", ""), '"', "'"), F.lit('"'))


def between_headings(text: Column, first: str = "Abstract", last: str = "Introduction") -> Column:
    """What stands between the last ``first`` before the last ``last``, whatever the case; linear in the text."""
    fold_case = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def before_last(t: Column) -> Column:
        low = fold_case(t)
        n = F.length(t) - F.length(F.substring_index(low, last.lower(), -1)) - len(last)
        return F.when(F.contains(low, F.lit(last.lower())), F.substring(t, F.lit(1), n)).otherwise(F.lit(""))

    def after_first(head: Column) -> Column:
        low = fold_case(head)
        n = F.length(F.substring_index(low, first.lower(), -1))
        return F.when(F.contains(low, F.lit(first.lower())), F.substring(head, F.length(head) - n + 1, n)).otherwise(F.lit(""))

    return let(before_last(text), after_first)


def doc_tag(text: Column, n: int = 20) -> Column:
    """The first ``n`` ASCII letters and digits."""
    return F.substring(F.regexp_replace(text, "[^a-zA-Z0-9]", ""), 1, n)


def fingerprint(text: Column, chars: int = 500) -> Column:
    """Letters and digits of the first ``chars`` characters, in lower case."""
    return F.regexp_replace(F.lower(F.substring(text, 1, chars)), "[^a-zA-Z0-9]", "")


def file_name(url: Column) -> Column:
    """A file's name from its link, without separators, ending and query."""
    last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    return F.translate(F.regexp_replace(last, r"(?i)\.pdf$", ""), ",:. ", "")


def deabbreviate_pairs(text: Column) -> Column:
    """``Long Form (LF)`` definitions as (long, short) structs; the short form's letters open the long form's words."""
    found = F.regexp_extract_all(text, F.lit(r"((?:\p{L}[\p{L}\p{N}-]*\s+){2,6}\([A-Z]{2,6}\))"), F.lit(1))

    def pair(x: Column) -> Column:
        short = F.regexp_extract(x, r"\(([A-Z]+)\)$", 1)
        all_words = F.filter(F.split(F.regexp_replace(x, r"\s*\([A-Z]+\)$", ""), r"\s+"), lambda w: w != "")
        words = F.slice(all_words, F.greatest(F.lit(1), F.size(all_words) - F.length(short) + 1), F.length(short))
        heads = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
        return F.struct(F.array_join(words, " ").alias("long"), short.alias("short"), (heads == short).alias("fits"))

    return F.transform(F.filter(F.transform(found, pair), lambda p: p["fits"]), lambda p: F.struct(p["long"].alias("long"), p["short"].alias("short")))
