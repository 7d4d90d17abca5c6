"""HTML to text with headers, lists and paragraphs, by rules for each kind of site."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import each

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset("script style noscript template head".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "h4": {"p"}, "ul": {"p"}, "ol": {"p"}, "table": {"p"}, "div": {"p"}}


@dataclass(frozen=True)
class HtmlRules:
    """Prefixes of block tags; tags, classes and ids that are skipped; headings that end the text or begin it; line rules."""

    marks: tuple[tuple[str, str], ...] = (("h1", "\n\n# "), ("h2", "\n\n# "), ("h3", "\n\n## "), ("h4", "\n\n### "), ("li", "\n- "), ("p", "\n"))
    skip_tags: tuple[str, ...] = ("table", "nav", "footer", "form")
    skip_names: str = r"\btoc\b|\bad\b|\bads\b|\bads?[-_]|cookie|banner"
    stop_headings: str = r"^References$|^See also"
    start_headings: str = ""
    strip_numbers: bool = False
    drop_templates: bool = False


WIKI = HtmlRules(drop_templates=True)
CLINIC = HtmlRules(marks=(("h2", "\n "), ("li", "\n- "), ("p", "\n")), skip_names=r"references|acces-list-container|tableofcontents|\bad\b", stop_headings="^$")
NICE = HtmlRules(strip_numbers=True, stop_headings="^$")
HOSPITAL = HtmlRules(start_headings="(?i)key points", stop_headings="(?i)^(?:parent information|additional notes|last updated|references)")


class _Reader(HTMLParser):
    def __init__(self, rules: HtmlRules):
        super().__init__(convert_charrefs=True)
        self.rules, self.marks = rules, dict(rules.marks)
        self.stack: list[tuple[str, bool]] = []
        self.out: list[str] = []
        self.block: str | None = None
        self.held: list[str] = []
        self.done = False
        self.begun = not rules.start_headings

    def hidden(self) -> bool:
        return any(h for _, h in self.stack)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = _CLOSES.get(tag, set())
        if self.stack and self.stack[-1][0] in closes:
            self.handle_endtag(self.stack[-1][0])
        if tag in _VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        names = " ".join(v for k, v in attrs if k in ("class", "id") and v)
        hide = tag in _HIDDEN or tag in self.rules.skip_tags or bool(names and re.search(self.rules.skip_names, names))
        self.stack.append((tag, hide))
        if tag in self.marks and not self.hidden() and not (tag == "p" and self.block == "li"):
            self.flush()
            self.block = tag

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            open_, _ = self.stack.pop()
            if open_ == self.block:
                self.flush()
            if open_ == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.block and not self.done and not self.hidden():
            self.held.append(data)

    def flush(self) -> None:
        tag, text = self.block, re.sub(r"[ \t\r\n]+", " ", "".join(self.held)).strip()
        self.block, self.held = None, []
        if tag is None or self.done or not text:
            return
        if tag[0] == "h":
            if not self.begun and re.search(self.rules.start_headings, text):
                self.begun = True
            if self.begun and re.search(self.rules.stop_headings, text):
                self.done = True
                return
            if self.rules.strip_numbers:
                text = re.sub(r"^\d+(?:\.\d+)*\s*", "", text)
        if self.rules.strip_numbers:
            text = re.sub(r"\[\d+\]", "", text)
        if self.rules.drop_templates and re.match(r"\||\{\{|\}\}", text):
            return
        if self.begun:
            self.out.append(self.marks[tag] + text)


def to_text(html: str | None, rules: HtmlRules = WIKI) -> str | None:
    if html is None:
        return None
    reader = _Reader(rules)
    reader.feed(html)
    reader.close()
    reader.flush()
    return "".join(reader.out).strip()


def html_text(html: Column, rules: HtmlRules = WIKI) -> Column:
    return each(lambda h: to_text(h, rules), "string")(html)


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_links(html: Column) -> Column:
    """Distinct link targets in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#>]+)"""), F.lit(1)))
