"""Rule tables: (pattern, replacement) pairs and word lists. Patterns run in Java and in RE2; replacements use ``$n``."""

MOJIBAKE = [(bad, good) for good in "ëéèïö" for bad in [good.encode().decode("cp1252")]]
MASK_DIGITS = [("[0-9]", "#"), ("[0-9]{2}", "##"), ("[0-9]{3,}", "###"), (r"\s{2,}", " ")]
MASK_DIGITS_LONGEST = [("[0-9]{3,}", "###"), ("[0-9]{2}", "##"), ("[0-9]", "#"), (r"\s{2,}", " ")]
URLS = [(r"(?:https?)?://(?:[0-9A-Za-z_./?=&%-]*[0-9A-Za-z_])?", "")]
REFERENCES = [("<[^\n]*?>", ""), (r"\[[^\n]*?\][(][^\n]*?[)]", ""), (r"\[[^\n]*?\]", "")]
BULLET = chr(0xF0B7)
LISTS = [("\n[*] ", "\n- "), ("\n[•%s]" % BULLET, "\n-"), (r"\n\+ ", "\n- "), ("• ", "- "), (r"\* ", "- ")]
LISTS_PARITY = [*LISTS[:2], ("\no", "\n-"), *LISTS[2:]]
GLYPHS = [("[◆•%s▪■□]" % BULLET, ""), (r"\*-", ""), ("\n>", "\n"), (r"\*\*", ""), (chr(0xFFFD), "")]
PMC_TAGS = [(rf"(?s)<{t}[^>]*>.*?</{t}{end}>", "") for t, end in (("xref", ""), ("label", ""), ("mml", "[^>]*"))] + [("<[^>]+>", ""), (r"\s+", " ")]
PARAGRAPH_TAGS = [(rf"<{t}[^>]*>.*?</{t}>", "") for t in ("ext-link", "xref")] + [("<[^>]+>", "")]
XML_ENVELOPE = [(r"<[?]xml[^<>]+[?]>", ""), (r"<!DOC[^<>]+>\r?(<PubmedArticleSet>)", "$1"), ("(?:</xml>){2,}", "</xml>"), (">>", ">")]
RTF = [(r"\\[\n]?[a-zA-Z]+[\n]?(?:[0-9]+|-[0-9]+)? ?|\{[*]?\\[^{}]+\}|[{}]", "")]
SUMMARY = [(r"(?i)\b(?:chapter|hoofdstuk|paragraaf|paragraph|samenvatting|summary)\b", ""), (r"\s{2,}", " "), ("\t", " "), (r"(?i)^\s*(?:appendices|appendix|dankwoord|dutch|english|engelse|nederlandse|publications|references)\b", "")]
PAGE = [(r"([0-9]+)\n", ""), ("^[0-9]+", ""), (r"(?m)^[ \t]*[0-9]+[ \t]*$", ""), ("\n+", "\n"), (r"\n\s*\n", "\n"), (r"^\s*\n", ""), (r"\n\s*$", ""), (r"\s+", " ")]
SQUEEZE_NONWORD = [(r"[^\p{L}\p{N}_]{3,}", " ")]
DOUBLE_BRACKETS = [(r"\[\[.*\]\]", "")]
UNDERSCORES = [("_{2,}", "[PII]")]
EMPTY_CITATIONS = [(r"\[,*\]", "")]
LINE_BREAKS = [(r"[\r\n]{2,}|\r\n", "\n")]
HEADING_NUMBERS = [(r"(?m)^[0-9]+(?:\.[0-9]+)*\s*", ""), (r"\[[0-9]+\]", "")]
WIKI_TEMPLATES = [(r"(?m)^(?:\||\{\{|\}\}).*$", "")]
REPEATS = [(r"\b(\w+)(?:[\s]+\1(?!\w))+", "$1"), (r"(\W)\1+", "$1")]
EMAIL = [(r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.[A-Za-z]{2,5}", "<EMAIL>")]

_SEP, _DAY, _YEAR = r"[-/\\]?", r"\d\d?", r"[12]\d\d\d"
DATES = [(_SEP.join(parts), "[DATUM]") for parts in ((_YEAR, _DAY, _DAY), (_DAY, _DAY, _YEAR))]
NUMBERS = [(r"[0-9]+\.[0-9]+", "[FLOAT]"), ("[0-9]+", "[INT]")]
LINKS = [(r"(?i)https?://[A-z0-9./?=-]+|www\.[A-z0-9./?=-]+", "[URL]")]
DOI = [(r"(?i)DOI\s[0-9./_-]+", "[DOI]")]
PATIENT = [(r"(?i)(?:pat(?:id|nummer|ientnr|i[eë]ntnummer|\.?num\.?)|verwij(?:s|zers)nummer)[\s:;]\s?[0-9]{5,12}", "[PATIENTNUMMER]")]
SIMPLE_TAGS = [(r"-[0-9]\]", "]")]
#: Dutch numbers: mobile and ten-digit forms, area code forms, bracketed and international forms; never inside a tag.
PHONES = [
    (r"(?<![0-9])(?:0031|\+31|0)[\s-]?[1-9][0-9]{8}(?![0-9])(?![^<]*>)", "[TELEFOONNUMMER]"),
    (r"(?<![0-9])0[1-9]{2}[0-9]{1,2}[\s-]?[1-9][0-9]{5}(?![0-9])(?![^<]*>)", "[TELEFOONNUMMER]"),
    (r"(?<![0-9])(?:0031|\+31|0)[1-9][0-9][\s-]?[1-9][0-9]{6}(?![0-9])(?![^<]*>)", "[TELEFOONNUMMER]"),
    (r"(?<![0-9])(?:\([0-9]{3}\)|[0-9]{3})\s?[0-9]{3}\s?[0-9]{2}\s?[0-9]{2}(?![0-9])(?![^<]*>)", "[TELEFOONNUMMER]"),
    (r"(?<![0-9])[0+][0-9]{2,3}[-\s][0-9]{4,8}(?![0-9])", "[TELEFOONNUMMER]"),
]


def _starred(body: str) -> str:
    return r"\[\*\*" + body + r"\*\*\]"


def _placeholders() -> list[tuple[str, str]]:
    """Typed tags for ``[**...**]`` placeholders of clinical notes."""
    digits = "[0-9]{1,4}"
    few, odd = "[0-9]{0,5}", "[0,9]{0,5}"
    two, upto4 = "[0-9]{1,2}", "[0-9]{0,4}"
    table = {
        "DATE": ["[0-9]{4,5}-[0-9]{1,2}-[0-9]{1,2}", rf"Month \(only\) {digits}"],
        "PATIENT_NAME": [rf"Name{digits} \(NameIs\)\s[0-9]{{0,4}}"],
        "PATIENT_FIRST_NAME": ["Known firstname [0-9]{1,5}"],
        "PATIENT_LAST_NAME": ["Known lastname [0-9]{1,5}"],
        "FIRST_NAME": [rf"First Name{odd} \({kind}\)\s{tail}" for kind, tail in (("LF", ""), ("Titles", ""), (f"NamePattern{few}", ""), (f"NamePattern{few}", digits))],
        "LAST_NAME": [rf"Last Name{odd} \({kind}\)\s{tail}" for kind, tail in (("STitle", ""), ("Titles", ""), (f"NamePattern{few}", ""), (f"NamePattern{few}", digits))] + [f"Known lastname {odd}"],
        "DOCTOR_ID": [rf"MD Number\(?[0-9,]{{0,3}}\)? {digits}"],
        "HOSPITAL": [f"Hospital[0-9]{{0,2}} {digits}", "Hospital[0-9]{0,2} ", rf"Location \(un\) {upto4}", f"Hospital Unit Name {digits}", f"Hospital Ward Name {digits}"],
        "DOCTOR_LAST_NAME": ["Doctor Last Name "],
        "DOCTOR_FIRST_NAME": ["Doctor First Name "],
        "DETAIL": ["[0-9]{1,2}-[0-9]{1,2}"],
        "MEAS_VALUE": ["[0-9]{1,5}"],
        "PHONENUMBER": [rf"Telephone/Fax \({two}\) {two}[0-9]{{2}}"],
        "ADDRESS": [rf"Apartment Address\([0-9]{{1,2}}\) {digits}"],
        "IDENTIFIER": [f"Numeric Identifier {digits}", "Job Number [0-9]{1,6}"],
    }
    return [(_starred(body), f"[{tag}]") for tag, bodies in table.items() for body in bodies]


PLACEHOLDERS = _placeholders()

#: Medical terms that mark a Dutch text as relevant, and terms that mark it as not.
INCLUDE_TERMS = sorted(
    """carcinoom tumor metastase oncologie biopsie excisie incisie invasief weefselonderzoek hartinfarct cardiologie cardiomyopathie atherosclerose
    aderverkalking hypertensie NSTEMI STEMI kortademigheid inhalatie medicatie medicijnen medicamenteus bijwerkingen prednison prednisolon pijnstiller
    pijnstilling pijnklachten anesthesie ontstekingsremmer ontstekking inflammatie artritis artrose chondrocalcinose orthopedisch prothese neuropathie
    neurodegeneratie psychiatrisch anamnese anatomie pathologie pathologisch patologisch ziekte ziekteverloop diabetes obesitas chronisch genetisch
    immunologie proteine proteoom toxicologie""".split()
    + ["cardiale pathologie", "reumatoide artritis"]
)
EXCLUDE_TERMS = sorted("wrok liefde muziek winst aanbieding webwinkel webshop marketing commercieel heerlijk vrolijk auto huizen showbusiness feesten".split() + ["leuk ", "lekker "])

#: Phrases that mark a page as front or back matter.
PAGE_PHRASES = {
    "references": ["literatuurlijst", "literature", "references", "referenties", "bibliography"],
    "figures": ["lijst van figuren", "list of figures"],
    "abbreviations": ["lijst van afkortingen", "list of abbreviations"],
    "copyright": ["copyright", "uitgeverij", "all rights reserved", "no part of this publication may be reproduced"],
    "thesis": ["de graad van doctor aan", "volgens besluit van het college voor promoties"],
    "contents": ["table of contents", "inhoudsopgave"],
    "thanks": ["dankwoord", "dankbetuiging", "acknowledgements"],
    "publications": ["lijst van publicaties", "list of publications", "bibliografie"],
}
