"""Normalisers for eighteen guideline sources and the pipeline around them.

A source is described by data (where its text starts and stops, which lines go) and at
most one function of its own; all of them run in one Arrow pass over the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.batches import STEP
from ..functions.text import fingerprint
from .dedup import first_per_key

_NO_LETTERS = re.compile("[^a-zA-Z ]")
_ONLY_LETTERS = re.compile("[^a-zA-Z]")


def _sub(rules: Sequence[tuple[str, str]], text: str) -> str:
    for pattern, new in rules:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", new), text)
    return text


def truncate(text: str, starters: Sequence[str] = (), removers: Sequence[str] = (), stoppers: Sequence[str] = ()) -> str:
    """From the first line that begins with a starter (which throws away what came before) to the first that begins with a stopper, without removers' lines and lines without letters."""
    starters, removers, stoppers = ([p.lower() for p in x] for x in (starters, removers, stoppers))
    kept, begun = [], False
    for line in text.split("\n"):
        low = line.lower()
        plain = _NO_LETTERS.sub("", low).strip()
        forms = (line, low.strip(), low.replace("#", "").strip(), plain)

        def begins(phrases: Sequence[str], forms: tuple = forms) -> bool:
            return any(f.startswith(p) for p in phrases for f in forms)

        if not begun and begins(starters):
            kept, begun = [line], True
        elif begins(removers):
            continue
        elif begins(stoppers):
            break
        elif plain:
            kept.append(line)
    return "\n".join(kept).strip()


def sections(text: str, most: int = 3) -> str:
    depths = [len(x) - 1 for x in re.findall("\n#+", text)]
    if not depths:
        return text
    return re.sub("\n#{%d,}" % most, "\n" + "#" * most, re.sub("\n#{%d}" % min(depths), "\n#", text))


def clean_text(text: str) -> str:
    """The common chain, as ``functions.text.clean`` does it on columns."""
    text = sections(_sub([*R.URLS, *R.REFERENCES, *R.LISTS, *R.GLYPHS], text))
    kept = "".join(x + "\n" for x in text.split("\n") if re.search("[a-zA-Z]", x))
    return _sub([(r"\n\s*\n", "\n"), ("\n#", "\n\n#")], kept).strip()


def _lines(text: str, fn: Callable[[str], str | None]) -> str:
    """Every line through ``fn``; None drops it."""
    return "".join(x + "\n" for x in map(fn, text.split("\n")) if x is not None)


def _phrases(text: str) -> tuple[str, ...]:
    return tuple(x for x in text.split("~") if x)


@dataclass(frozen=True)
class Source:
    starters: str = ""
    removers: str = ""
    stoppers: str = ""
    process: Callable[[dict, "Source"], dict | None] | None = None
    line: Callable[[str], str | None] | None = None
    least_lines: int = 0

    def cut(self, text: str) -> str:
        return truncate(text, _phrases(self.starters), _phrases(self.removers), _phrases(self.stoppers))

    def __call__(self, g: dict) -> dict | None:
        if self.process:
            return self.process(g, self)
        text = self.cut((g["text"] or "").strip())
        if self.line:
            text = _lines(text, self.line)
        text = clean_text(text)
        return None if len(text.split("\n")) < self.least_lines else {"title": g["title"], "text": text}


def _few_words(line: str, least: int = 3) -> bool:
    return len(line.split()) < least


def _long_lines(text: str, words: int = 10) -> int:
    return sum(len(x.split(" ")) > words for x in text.split("\n"))


def _aafp(g: dict, s: Source) -> dict | None:
    text = (g["text"] or "").strip()
    told = [x.strip() for x in text.split("\n") if x.startswith("The AAFP supports")]
    if told and told[0].endswith("on this topic."):
        return None
    title = re.sub(r" \| AAFP| - Choosing Wisely", "", (g["title"] or "").strip())

    def line(x: str) -> str | None:
        bare = x.lower().replace("#", "").strip()
        echo = all(len(w) == 1 for w in bare.split()) or title.lower().startswith(bare) or "|" in bare or "http" in bare
        return None if echo else x

    return {"title": title, "text": clean_text(f"{title}\n\n" + _lines(s.cut(text), line))}


def _cco_line(x: str) -> str | None:
    if x.strip().startswith("•"):
        return "- " + x[1:].strip()
    return None if _few_words(x) or not _ONLY_LETTERS.sub("", x) else re.sub("^o ", "- ", x)


def _cdc_diseases(g: dict, s: Source) -> dict | None:
    text = (g["text"] or "").strip()
    if text.split("\n")[0].strip() == "### Disease Directory":
        return None
    text = s.cut(text)

    def line(x: str) -> str | None:
        if _few_words(x) or any(p in x for p in _phrases(s.removers)):
            return None
        return x.replace("+ ", "- ").replace("**", "").replace("*", "- ")

    return {"title": text.split("\n")[0][3:].strip(), "text": f"{g['title'] or ''}\n\n" + _lines(text, line)}


def _cdc(g: dict, s: Source) -> dict | None:
    out = []
    for x in (g["text"] or "").strip().split("\n"):
        letters = _ONLY_LETTERS.sub("", x)
        if not re.sub("[•#]", "", x).strip():
            continue
        if x.startswith("q "):
            out.append("- " + x[2:].strip())
        elif letters.lower().startswith("acknowledg"):
            break
        elif x.startswith("#") and letters == letters.upper():
            out.append(" ".join(w.capitalize() for w in x.split(" ")))
        else:
            out.append(x.strip())
    return {"title": g["title"], "text": re.sub("\n# -", "\n#", clean_text("".join(x + "\n" for x in out)))}


def _cma(g: dict, s: Source) -> dict | None:
    text = (g["text"] or "").strip()
    title = text.split("\n")[0]
    out, in_table = [], False
    for x in s.cut(text).split("\n"):
        if x.strip().lower().startswith(("table", "figure")):
            in_table = True
        elif "|" in x or (title and title in x):
            continue
        elif in_table:
            in_table = x != ""
        else:
            out.append(x)
    return {"title": title, "text": clean_text(f"{title}\n\n" + "".join(x + "\n" for x in out))}


def _cma_pdf_line(x: str) -> str | None:
    bare = re.sub("[#.]", "", x).strip().lower()
    if bare in ("", "•") or bare.isdigit():
        return None
    return re.sub(r"^\d+\.\s", "- ", x)


def _drugs(g: dict, s: Source) -> dict | None:
    text = "\n".join(x for x in (g["text"] or "").strip().split("\n") if "|" not in x)
    text = _sub([(r"\*", "-"), (r"[\[\]]", ""), (r"\([^)]+\)", ""), ("--", "")], s.cut(text))
    return {"title": (g["title"] or "").split(" - ")[0].strip(), "text": clean_text(text.strip())}


def _gc(g: dict, s: Source) -> dict | None:
    title, text = (g["title"] or "").strip(), (g["text"] or "").strip()
    if title == "Title":
        title, text = "", text[6:]
    title, text = (re.sub(r'\["|"\]', "", x) for x in (title, text))

    def line(x: str) -> str | None:
        x = x.strip()
        shout = re.sub("[^a-zA-Z0-9]", "", x)
        return None if x == "(c)" else f"\n# {x}" if shout.isupper() and len(shout) > 2 else x

    text = clean_text(_lines(s.cut(text), line))
    return None if _long_lines(text) < 3 else {"title": title, "text": text}


def _icrc_line(x: str) -> str | None:
    if not _ONLY_LETTERS.sub("", x):
        return None
    return "- " + x[1:].strip() if re.match(r"\d+[a-zA-Z]", x) else x


def _idsa(g: dict, s: Source) -> dict | None:
    text = (g["text"] or "").strip()
    if "This new guideline is currently in development" in text:
        return None
    title = text.split("\n")[0]

    def line(x: str) -> str | None:
        bare = x.lower().replace("#", "").strip()
        if bare.split(".")[0].isdigit():
            return "- " + x[bare.find(".") + 1 :].strip()
        return None if title.lower().startswith(bare) else x

    text = _sub([(" ,", ""), (r" \.", "."), (r"\*", ""), (r" \)", ""), (r"-\. ", "- ")], f"{title}\n\n" + _lines(s.cut(text), line))
    text = clean_text(text)
    return None if len(text.split("\n")) < 5 else {"title": title, "text": text}


def number_framed_headers(rows: list[str]) -> list[str]:
    """Lines between two numbers become headers; the walk looks at three lines at a time."""
    out, i = [], 0
    while i < len(rows):
        if i >= len(rows) - 3:
            out += rows[i:]
            break
        before, now, after = (x.strip() for x in rows[i : i + 3])
        if before.isdigit() and after.isdigit() and not now.isdigit():
            out.append(f"# {now}")
            i += 2
        else:
            out.append(now)
            i += 1
    return out


_MAGIC_SECTIONS = _phrases(
    "acknowledgements~acknowledgments~authorship~contributors~date of publication~declarations of interest~disclaimer~disclosure~external reviewers~funding~isbn~members~previous versions in magicapp~publication approval~publisher~references"
)


def _magic(g: dict, s: Source) -> dict | None:
    chunks = (g["text"] or "").strip().split("Loading Data...\n")
    text = "".join(c + "\n\n" for c in chunks if not re.search("Write (?:header|remark) here", c))
    text = s.cut("\n".join(number_framed_headers(text.split("\n"))))
    text = _lines(text, lambda x: None if not x.replace("#", "").strip() or "|" in x else x.strip())
    text = _sub([("\n+", "\n"), (r"\n\*\*", "\n## "), (r"\*", ""), (r"\n([();])", "$1")], text).strip()
    parts = [p for p in text.split("\n\n") if not _NO_LETTERS.sub("", p.split("\n")[0].lower()).strip().startswith(_MAGIC_SECTIONS)]

    def line(x: str) -> str | None:
        if x.startswith("!") or re.sub("[^a-zA-Z0-9 ]", "", x).strip().isdigit():
            return None
        return x.replace("#", "").strip() if x.startswith("#") and len(x.split(" ")) > 7 else x

    return {"title": g["title"], "text": clean_text(_lines("".join(p + "\n\n" for p in parts), line))}


def join_sections(named: Sequence[tuple[str, str]]) -> str:
    return "".join(f"# {name}\n\n{body}" for name, body in named)


def _named_sections(g: dict) -> list[tuple[str, str]]:
    """Sections of a record: given as pairs, or the text under its header lines."""
    given = g.get("sections")
    if given is not None and len(given):
        return [(s["name"], s["text"]) for s in given]
    parts = re.split(r"(?m)^#+ *(.*)\n", "# \n" + (g["text"] or ""))[1:]
    return [(n, b) for n, b in zip(parts[::2], parts[1::2]) if n or b.strip()]


def _mayo(g: dict, s: Source) -> dict | None:
    text = clean_text(join_sections(_named_sections(g)))
    return {"title": g["title"], "text": "\n".join(x for x in text.split("\n") if "MayoClinic" not in x)}


def nice_sections(named: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Sections on discussion, and all that aren't about the making of the guideline."""
    return [(n, b) for n, b in named if "discussion" in n.lower() or not re.search("advice|committee|implementation|team|update", n.lower())]


def _nice(g: dict, s: Source) -> dict | None:
    kept = nice_sections(_named_sections(g))
    lead = "".join(f"{x}\n\n" for x in (g["title"], g.get("overview")) if x)
    return {"title": g["title"], "text": lead + clean_text(join_sections(kept))} if kept else None


def _rch(g: dict, s: Source) -> dict | None:
    return {"title": g["title"], "text": g["text"] or ""}


def _spor(g: dict, s: Source) -> dict | None:
    text = s.cut((g["text"] or "").strip()).replace("|", "").replace("---", "\n")
    return {"title": g["title"], "text": clean_text(_lines(text, lambda x: None if _few_words(x) else x.strip()))}


def _who_line(x: str) -> str | None:
    return None if _few_words(x) else x.replace("• ", "- ").replace(chr(0xE031), "").strip()


def _wikidoc(g: dict, s: Source) -> dict | None:
    out, quiet = [], False
    for x in s.cut(g["text"] or "").split("\n"):
        if x.startswith("Any recommendations found on these pages"):
            quiet = True
        elif x.startswith("#"):
            quiet = False
            out.append(x)
        elif not quiet and not x.startswith("CLASS"):
            out.append(x)
    text = clean_text(re.sub("Redirect to.*", "", "".join(x + "\n" for x in out)))
    return None if _long_lines(text) < 3 else {"title": g["title"], "text": text}


def _cps_line(x: str) -> str | None:
    return None if _few_words(x) or any(p in x for p in _phrases(SOURCES["cps"].removers)) else x.strip()


SOURCES: dict[str, Source] = {
    "aafp": Source("recommendation~key recommendations~clinical preventive service recommendation", "http~[~**[~---~===", r"sources~references~related content~more about practice guidelines~more about choosing wisely~*keyboard\_tab*~*these guidelines are provided only~*these recommendations are provided only", _aafp),
    "cco": Source("INTRODUCTION~QUESTIONS~GUIDELINE OBJECTIVES~INTENDED PURPOSE", "This report is copyrighted by~This is a quick reference guide~These guidelines recommendations have been endorsed~Care has been taken in the preparation ~An assessment conducted in ", line=_cco_line),
    "cdc": Source(process=_cdc),
    "cdc_diseases": Source("###", "insurance~ | CDC", "After Travel~More Information", _cdc_diseases),
    "cma": Source("overview~preamble~introduction~key information~### what~### abstract~### 1. what~### key information", "|~[~![~* [~+ [~---~===~table~figure~footnote~refer to", "appendix~references~### references~selected references~### selected references~acknowledgements~acknowledgments~additional resources~additional tables~list of abbreviations~report a problem~### authors’ statement", _cma),
    "cma_pdfs": Source(stoppers="funding~disclaimer~acknowledg~conflict of interest", line=_cma_pdf_line),
    "cps": Source("### Abstract", "|~Figure~Key words:~Keywords:~The Canadian Paediatric Society gives permission", "Selected resources~Acknowledgements~Current:  About CPS position", line=_cps_line, least_lines=3),
    "drugs": Source(removers="[~* [~###~---~===~[Medical~More about~Further information~Frequently asked~Always consult your healthcare provider", process=_drugs),
    "gc": Source("Document Objectives", "(c)~www~http~Publication Date", "Source Citation~Recommendation Grading~Disclaimer", _gc),
    "icrc": Source(stoppers="contacts~acknowledgments~acknowledgements", line=_icrc_line),
    "idsa": Source("abstract~introduction", "[!~---~===~published~appropriate use criteria", "notes~references~disclaimer~acknowledgments~supplementary~for more information~to access a more user~to view the full version", _idsa),
    "magic": Source("introduction~abstract", "![~---~===~< less~more >~updates~about this guideline~loading data...~please visit the~view section text~write general section text", "", _magic),
    "mayo": Source(process=_mayo),
    "nice": Source(process=_nice),
    "rch": Source(process=_rch),
    "spor": Source(stoppers="CONFLICT OF INTEREST", process=_spor),
    "who": Source("Introduction ", "|~Under the terms of this licence", "Acknowl", line=_who_line),
    "wikidoc": Source("", "Media:~Editor~Template:~Click here~Associate Editor~To go back to the main page~How to edit trial information~For patient information click here", "external links", _wikidoc),
}


def process_guidelines(df: DataFrame, language: Callable[[Column], Column] | None = None, min_chars: int = 10) -> DataFrame:
    """(id, source, title, clean_text, raw_text, url, overview) of the rows (source, position, title, text, url, overview) that their source's rules keep.

    Order as documented: rules, language, then one row of each opening; ids are the SHA-1 of source and place within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):  # few rows are Python objects at once
                some = batch.slice(at, STEP)
                found = [SOURCES[g["source"]](g) if g["source"] in SOURCES else None for g in some.to_pylist()]
                new = [pa.array([f and f[c] for f in found], pa.string()) for c in ("title", "text")]
                out = pa.RecordBatch.from_arrays([*some.columns, *new], [*some.schema.names, "new_title", "clean_text"])
                yield out.filter(new[1].is_valid())

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = df.mapInArrow(run, f"{kinds}, new_title string, clean_text string").where(F.length("clean_text") > min_chars)
    if language is not None:
        rows = rows.where(language(F.col("clean_text")) == "en")
    rows = first_per_key(rows, [fingerprint(F.col("clean_text"))], ["source", "position"])
    return with_ids(rows).select("id", "source", F.col("new_title").alias("title"), "clean_text", F.col("text").alias("raw_text"), "url", "overview")


def with_ids(df: DataFrame, source: str = "source", position: str = "position", out: str = "id") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(source).orderBy(position)) - 1
    return df.withColumn(out, F.sha1(F.concat(F.col(source), place.cast("string"))))


def combine_sources(df: DataFrame, min_chars: int = 10, only: Sequence[str] = ()) -> DataFrame:
    """Rows with enough text, from sources whose name holds one of ``only``."""
    rows = df.where(F.length("clean_text") > min_chars)
    return rows.where(F.col("source").rlike("|".join(map(re.escape, only)))) if only else rows
