"""SRC9: documents of four layouts as text with headings and paragraphs: papers, minutes, transcripts, contracts.

Web pages become blocks by marking where block tags open and close; all else of a tag goes.  An opening block tag ends
a paragraph that wasn't closed, as browsers have it, so no nesting is needed and a page is read once from left to right.
A null page has no text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

_CUT, _KIND = "\x01", "\x02"
#: Paragraphs of a page count from so many characters on, more than 40; turns of a transcript need more than 20.
LEAST, LEAST_TURN = 41, 21
_HIDDEN = ("script", "style", "math", "cite", "head")
_BLOCKS = "h[1-6]|p|div|article|section|main|aside|header|footer|nav|ul|ol|li|dl|dt|dd|table|tr|td|th|blockquote|pre|figure|body|html"
#: (pattern, replacement with its first group) in order; both Spark and DuckDB know them.
MARKS = (
    ("[\x01\x02]", " "), (r"(?s)<!--.*?-->", " "), *((rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ") for t in _HIDDEN),
    (r"(?i)<(h[1-6]|p)(?:\s[^>]*)?>", rf"{_CUT}\1{_KIND}"), (rf"(?i)</?(?:{_BLOCKS})(?:\s[^>]*)?/?>", _CUT), (r"(?s)<[^>]*>", " "),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
NUMBERING = r"^[0-9]+(?:\.[0-9]+)*\s*"


def _plain(x: Column) -> Column:
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return T.normalize_ws(x)


def blocks(html: Column) -> Column:
    """The blocks of a page that have text, in order: structs (kind, text); the kind is h1 to h6, p or empty."""
    for pattern, by in MARKS:
        html = F.regexp_replace(html, pattern, by.replace("\\1", "$1"))
    parts = F.transform(F.split(html, _CUT), lambda x: F.split(x, _KIND, 2))
    made = F.transform(parts, lambda x: F.struct(F.when(F.size(x) > 1, F.lower(x[0])).otherwise("").alias("kind"), _plain(F.element_at(x, -1)).alias("text")))
    return F.filter(made, lambda b: b["text"] != "")


def blocks_sql(html: str) -> str:
    """The same as lists of structs."""
    for pattern, by in MARKS:
        html = f"regexp_replace({html}, {T.q(pattern)}, {T.q(by)}, 'g')"
    text = f"string_split(x, '{_KIND}')[-1]"
    for entity, char in ENTITIES:
        text = f"replace({text}, {T.q(entity)}, {T.q(char)})"
    return f"list_filter([{{'kind': CASE WHEN contains(x, '{_KIND}') THEN lower(string_split(x, '{_KIND}')[1]) ELSE '' END, 'text': {T.normalize_ws_sql(text)}}} FOR x IN string_split({html}, '{_CUT}')], lambda b: b.text <> '')"


def _lines(made: Column, line) -> Column:
    return F.array_join(F.filter(F.transform(made, line), lambda x: x.isNotNull()), "\n\n")


def research(html: Column, ends: Sequence[str] = ('class="ltx_bibliography"', "ltx_title_appendix")) -> Column:
    """A paper: headings without their numbers, h1 above h2 and h3, and paragraphs of more than 40 characters, up to the references."""
    for end in ends:
        html = F.substring_index(html, end, 1)

    def line(b: Column) -> Column:
        title = F.regexp_replace(b["text"], NUMBERING, "")
        return F.when(b["kind"] == "h1", F.concat(F.lit("# "), title)).when(b["kind"].isin("h2", "h3"), F.concat(F.lit("## "), title)).when((b["kind"] == "p") & (F.length(b["text"]) >= LEAST), b["text"])

    return _lines(blocks(html), line)


def research_sql(html: str) -> str:
    """The same of a page without references."""
    title = f"regexp_replace(b.text, {T.q(NUMBERING)}, '')"
    line = f"CASE WHEN b.kind = 'h1' THEN '# ' || {title} WHEN b.kind IN ('h2', 'h3') THEN '## ' || {title} WHEN b.kind = 'p' AND length(b.text) >= {LEAST} THEN b.text END"
    return f"array_to_string([{line} FOR b IN {blocks_sql(html)}], chr(10) || chr(10))"


def financial(html: Column, titles: Sequence[str], ends: Sequence[str] = ("Voting for this action", "Notation Vote", "Attendance"), start: str = 'id="article"') -> Column:
    """Minutes: from ``start`` on (all of a page without it), paragraphs that begin with one of the ``titles`` are led by it as a heading; the first that begins with one of ``ends`` ends the text."""
    at = F.instr(html, start)
    html = F.when(at > 0, F.concat(F.lit("<x "), F.substr(html, at))).otherwise(html)
    paragraphs = F.filter(blocks(html), lambda b: b["kind"] == "p")
    over = F.array_position(F.transform(paragraphs, lambda b: F.greatest(*[F.startswith(b["text"], F.lit(e)) for e in ends], F.lit(False))), True)
    kept = F.when(over > 0, F.slice(paragraphs, F.lit(1), F.greatest(over - 1, F.lit(0)).cast("int"))).otherwise(paragraphs)

    def line(b: Column) -> Column:
        found = F.coalesce(*[F.when(F.startswith(b["text"], F.lit(t)), F.lit(t)) for t in titles], F.lit(""))
        rest = F.trim(F.substr(b["text"], F.length(found) + 1))
        return F.when(found != "", F.concat(F.lit("## "), found, F.when(F.length(rest) >= LEAST, F.concat(F.lit("\n\n"), rest)).otherwise(""))).when(F.length(rest) >= LEAST, rest)

    return _lines(kept, line)


def transcript(text: Column, furniture: Sequence[str] = (r"\s*Page \d+ of \d+\s*",)) -> Column:
    """A transcript's text layer: lines that match ``furniture`` as a whole go, hyphenated line ends join, and each speaker (capitals and a full stop at a line's start) opens a paragraph; short ones go."""
    for pattern in furniture:
        text = F.regexp_replace(text, rf"(?m)^{pattern}$", "")
    text = F.regexp_replace(F.regexp_replace(text, "-\n(?=[a-z])", ""), r"\s*\n\s*(?=[A-Z][A-Z .'-]{3,40}\.\s)", "\n\n")
    return F.array_join(F.filter(F.transform(F.split(text, "\n\n"), T.normalize_ws), lambda p: F.length(p) >= LEAST_TURN), "\n\n")


def contract(raw: Column, title: str) -> Column:
    """The first paragraph's context of the contract of that title, of a question set as JSON."""
    data = F.from_json(raw, "data array<struct<title:string,paragraphs:array<struct<context:string>>>>")["data"]
    return F.get(F.get(F.filter(data, lambda d: d["title"] == title), F.lit(0))["paragraphs"], F.lit(0))["context"]
