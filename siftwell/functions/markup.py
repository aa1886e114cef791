"""HTML, CSV and Markdown to text."""

from __future__ import annotations

import csv
import io
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that break a line, and entities with their characters. The ampersand comes last so that nothing is decoded twice.
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_html(html: Column) -> Column:
    """Text of HTML: block tags become line ends, other tags go (their content stays, scripts included), a few entities are decoded, and runs of line ends shrink to two."""
    # A marker that no text holds keeps decoded angle brackets apart from tags.
    out = F.regexp_replace(html, r"(?s)<\s*/?\s*(?:" + "|".join(BLOCK_TAGS) + r")(?:\s[^>]*)?>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*(?:>|\z)", "")
    out = F.replace(out, F.lit(">"), F.lit(""))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"\A\n+", "")


def csv_text(text: str) -> str:
    """Cells joined by single spaces, rows by line ends."""
    csv.field_size_limit(max(len(text), 1) + 1)  # a cell may be as long as the text
    rows = csv.reader(io.StringIO(text.replace("\r\n", "\n").replace("\r", "\n"), newline="\n"))
    return "\n".join(" ".join(row) for row in rows)


def csv_to_text(text: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def quoted(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else csv_text(t) for t in texts.to_pylist()], pa.string())

    plain = F.regexp_replace(F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(","), F.lit(" ")), r"\n\z", "")
    return F.when(F.contains(text, F.lit('"')), quoted(text)).otherwise(plain)


_FENCE = re.compile(r"^\s{0,3}(```|~~~)")
_RULE = re.compile(r"^\s*([-*_])\s*(?:\1\s*){2,}$")
_INLINE = (
    (re.compile(r"`+([^`]*)`+"), r"\1"),
    (re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"!?\[([^\]]*)\]\[[^\]]*\]"), r"\1"),
    (re.compile(r"\*+"), ""),
    (re.compile(r"~~"), ""),
    (re.compile(r"(?<!\w)_+|_+(?!\w)"), ""),
)


def markdown_text(text: str) -> str:
    """Text of Markdown: marks of headings, quotes, fences, rules, links, emphasis and code go, their words stay; an underscore inside a word is literal."""
    out = []
    for line in text.split("\n"):
        if _FENCE.match(line) or _RULE.match(line):
            continue
        line = re.sub(r"^\s{0,3}(?:>\s?)+", "", line)
        line = re.sub(r"^\s{0,3}#{1,6}\s+", "", line)
        kept: list[str] = []
        line = re.sub(r"\\([\\`*_{}\[\]()#+\-.!>~|])", lambda m: kept.append(m[1]) or f"\x00{len(kept) - 1}\x00", line)
        for pattern, by in _INLINE:
            line = pattern.sub(by, line)
        out.append(re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], line))
    return "\n".join(out)


def strip_markdown(text: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def stripped(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else markdown_text(t) for t in texts.to_pylist()], pa.string())

    return F.when(text.rlike(r"[\\`*_~\[#>|-]"), stripped(text)).otherwise(text)


def extract_text(content: Column, mime: Column, path: Column) -> Column:
    """Text of UTF-8 bytes by kind: CSV, Markdown, HTML or plain, then without control characters. Bytes that aren't UTF-8 give null."""
    name = F.lower(F.coalesce(path, F.lit("")))
    text = F.try_validate_utf8(content.cast("string"))
    body = (
        F.when((mime == "text/csv") | name.endswith(".csv"), csv_to_text(text))
        .when((mime == "text/markdown") | name.endswith(".md") | name.endswith(".markdown"), strip_markdown(text))
        .when((mime == "text/html") | name.endswith(".html") | name.endswith(".htm"), strip_html(text))
        .otherwise(text)
    )
    return F.regexp_replace(body, r"[\p{Cc}&&[^\t\n\r]]", "")


def printable_strings(content: Column, least: int = 4) -> Column:
    """Maximal runs of at least `least` printable ASCII bytes."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[ -~]{{{least},}}"), F.lit(0))
