"""Text shaping as column expressions; Arrow functions only where a recurrence over characters rules built-ins out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES, OVERLAP_BYTES = 2048, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_control(text: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\t\n\r]]", "")


def _before_boundary(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def spans(data: bytes, size: int, overlap: int) -> list[tuple[int, int]]:
    """Byte windows of size with overlap. An end falls back to a character's first byte and the next start moves on to one, so starts can drift."""
    out, start = [], 0
    while start < len(data):
        end = _before_boundary(data, min(start + size, len(data)))
        if end <= start:
            break
        out.append((start, end))
        start += size - overlap
        while start < len(data) and data[start] & 0xC0 == 0x80:
            start += 1
    return out


def chunk_spans(text: Column, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> Column:
    """array<struct<idx, start, stop>> of a text's chunks. Texts of one-byte characters take the closed form; others walk the boundaries."""
    if size <= overlap:
        raise ValueError("size must be greater than overlap")
    kind = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))

    @F.arrow_udf(kind)
    def walk(texts: pa.Array) -> pa.Array:
        rows = [None if not t.is_valid else [{"idx": i, "start": a, "stop": b} for i, (a, b) in enumerate(spans(t.as_py(), size, overlap))] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("idx", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])))

    step, length = size - overlap, F.octet_length(text)
    plain = F.transform(
        F.sequence(F.lit(0), F.floor((length - 1) / step).cast("int")),
        lambda i: F.struct(i.alias("idx"), (i * step).alias("start"), F.least(i * step + size, length).alias("stop")),
    )
    return F.when(text == "", F.array().cast(kind)).when(F.length(text) == length, plain).otherwise(walk(text.cast("binary")))


def byte_slice(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text.cast("binary"), start + 1, stop - start).cast("string")


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within most bytes."""
    digits = F.hex(F.substring(text.cast("binary"), F.lit(1), F.lit(most + 1)))
    # A continuation byte begins with 8, 9, A or B. If the first byte cut off is one, the whole character goes: those before it and its first byte.
    inside = F.substring(digits, 2 * most + 1, 1).rlike("[89AB]")
    run = F.length(F.regexp_extract(F.substring(digits, 1, 2 * most), r"((?:[89AB][0-9A-F])*)\z", 1)) / 2
    keep = F.when(inside, most - 1 - run.cast("int")).otherwise(F.lit(most))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text.cast("binary"), F.lit(1), keep).cast("string"))


def token_cost_milli(text: Column) -> Column:
    """Estimated thousandths of a token: 250 for ASCII letters, digits and white space (vertical tab aside), 1000 for other ASCII, 2000 beyond."""
    prose = F.length(F.regexp_replace(text, r"[^A-Za-z0-9 \t\n\f\r]", ""))
    other = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) - prose
    beyond = F.length(text) - prose - other
    return (prose * 250 + other * 1000 + beyond * 2000).cast("long")


def _cost(c: str) -> int:
    return 250 if c.isascii() and (c.isalnum() or c in " \t\n\f\r") else 1000 if c.isascii() else 2000


_COSTS = np.array([_cost(chr(k)) for k in range(128)] + [2000], np.int64)


def _costs(text: str) -> np.ndarray:
    """The cost of each character."""
    return _COSTS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)]


def token_prefix(text: str, tokens: int) -> int:
    """Characters of the longest prefix whose cost is within tokens."""
    return int(np.searchsorted(np.cumsum(_costs(text)), tokens * 1000, "right"))


def truncate_tokens(text: Column, tokens: int) -> Column:
    """The longest prefix whose estimated cost is within tokens. A character costs a quarter of a token at least, so Python sees no more of a text than may stay."""

    @F.arrow_udf(T.IntegerType())
    def places(texts: pa.Array) -> pa.Array:
        return pa.array([None if not t.is_valid else token_prefix(t.as_py(), tokens) for t in texts], pa.int32())

    return F.when(token_cost_milli(text) <= tokens * 1000, text).otherwise(F.left(text, places(F.left(text, F.lit(4 * max(0, tokens) + 1)))))


# What stands between the two parts of a bounded text, its byte bound and the share of the first part.
MARKER, BOUND_BYTES, HEAD_SHARE, LOOK_BYTES = "\n\n… [content truncated] …\n\n", 480 * 1024, 0.7, 512


def bound_head_and_tail(text: str, tokens: int) -> str:
    """Head and tail of a text over its token budget, cut at a paragraph or line end where one is near; head alone if the two would overlap."""
    data = text.encode()
    text = data[: _before_boundary(data, min(len(data), BOUND_BYTES))].decode()
    costs = [_cost(c) for c in text]
    budget = tokens * 1000
    if sum(costs) <= budget:
        return text
    head_budget = int(budget * HEAD_SHARE)
    head = used = 0
    while used + costs[head] <= head_budget:
        used += costs[head]
        head += 1
    tail, used = len(text), 0
    while tail > 0 and used + costs[tail - 1] <= budget - head_budget:
        used += costs[tail - 1]
        tail -= 1
    near = _within(text, head, -LOOK_BYTES)
    for mark in ("\n\n", "\n"):
        if (at := text.rfind(mark, near, head)) >= 0:
            head = at + len(mark)
            break
    far = _within(text, tail, LOOK_BYTES)
    for mark in ("\n\n", "\n"):
        if (at := text.find(mark, tail, far)) >= 0:
            tail = at + len(mark)
            break
    return text[:head] if tail <= head else text[:head] + MARKER + text[tail:]


def _within(text: str, at: int, reach: int) -> int:
    """The place about `reach` bytes away, moved outwards to a whole character."""
    left, step = abs(reach), 1 if reach > 0 else -1
    while left > 0 and 0 <= at - (step < 0) < len(text):
        left -= len(text[at - (step < 0)].encode())
        at += step
    return at


def bound_text(text: Column, tokens: int) -> Column:
    """As bound_head_and_tail. Of a long text Python sees its first and last characters only: more than either part can have, with what is looked at for a line end."""

    @F.arrow_udf(T.StringType())
    def bound(texts: pa.Array) -> pa.Array:
        return pa.array([None if not t.is_valid else bound_head_and_tail(t.as_py(), tokens) for t in texts], pa.string())

    within = truncate_bytes(text, BOUND_BYTES)
    reach = 4 * max(0, tokens) + LOOK_BYTES + 1
    if 8 * reach <= BOUND_BYTES:
        within = F.when(F.length(within) <= 2 * reach, within).otherwise(F.concat(F.left(within, F.lit(reach)), F.right(within, F.lit(reach))))
    return F.when((F.octet_length(text) <= BOUND_BYTES) & (token_cost_milli(text) <= tokens * 1000), text).otherwise(bound(within))


def shrunk_place(text: str, attempt: int) -> int:
    """Characters that shrink_for_context leaves."""
    used = np.cumsum(_costs(text)) // 1000
    for _ in range(attempt if text else 0):
        target = max(1, int(used[-1]) // 2) if len(used) else 1
        used = used[: np.searchsorted(used, target)]
    return len(used)


def shrink_for_context(text: Column, attempt: int) -> Column:
    """The text of a retry after the model's window overflowed: cut before the character at which the whole tokens reach half the estimate, again for each attempt."""

    @F.arrow_udf(T.IntegerType())
    def places(texts: pa.Array) -> pa.Array:  # one text at a time, and only numbers go back
        return pa.array([None if not t.is_valid else shrunk_place(t.as_py().decode(), attempt) for t in texts], pa.int32())

    return F.left(text, places(text.cast("binary")))


def safety_factor(text: Column) -> Column:
    """0.8 if at least 85 % of the first 4096 characters are letters, digits or white space in ASCII, else 0.5; 0.5 for empty and null."""
    head = F.substring(text, 1, 4096)
    prose = F.length(F.regexp_replace(head, r"[^A-Za-z0-9 \t\n\f\r]", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.5).when(prose / F.length(head) >= 0.85, 0.8).otherwise(0.5)


def token_budgets(text: Column, context: Column) -> Column:
    """struct<text_budget, note_budget> for a context window of so many tokens."""
    safe = F.floor(context * safety_factor(text)).cast("long")
    return F.struct(F.greatest(F.lit(0), safe - 3300).alias("text_budget"), F.least(F.lit(1500), F.greatest(F.lit(0), context - 1800)).cast("long").alias("note_budget"))


def rough_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


# The sections of an enriched prompt in their order.
SECTIONS = ("USER TASK LIST", "USER DECISIONS", "RELEVANT PAST CONTEXT", "THREAD CONTINUITY")


def pack_context(prompt: Column, tasks: Column, decisions: Column, context: Column, thread: Column, most_tokens: Column, percent: int = 85) -> Column:
    """A prompt with its sections, those that aren't empty, before it. Where that is over the share of the window, every section has an equal part of the characters that are left beside the prompt; where
    the prompt alone fills it, there are no sections."""
    bodies = F.array(*[F.struct(F.lit(f"# [{name}]\n").alias("head"), F.coalesce(body, F.lit("")).alias("body")) for name, body in zip(SECTIONS, (tasks, decisions, context, thread), strict=True)])
    sections = F.filter(bodies, lambda s: s["body"] != "")
    budget = F.floor(most_tokens * (min(100, max(1, percent)) / 100)).cast("long")
    tail = F.concat(F.lit("---\n\n"), prompt)

    def block(p: Column, width: Column) -> Column:
        return F.array_join(F.transform(p["some"], lambda s: F.concat(s["head"], F.left(s["body"], width), F.lit("\n\n"))), "")

    def sized(some: Column) -> Column:
        """The sections with the characters of the whole prompt, of the prompt alone, and of each section if they don't all fit."""
        n = F.size(some)
        whole = F.aggregate(some, F.length(prompt) + F.when(n > 0, 9).otherwise(0), lambda a, s: a + F.length(s["head"]) + F.length(s["body"]) + 2)
        return F.struct(some.alias("some"), F.ceil(whole / 4).alias("whole"), F.ceil(F.length(tail) / 4).alias("own"), n.alias("n"))

    def packed(p: Column) -> Column:
        fits = p["whole"] <= budget
        width = F.when(fits, F.lit(2**31 - 1).cast("long")).otherwise(F.call_function("div", (budget - p["own"]) * 4, F.greatest(p["n"], F.lit(1)).cast("long"))).cast("int")
        return F.when((p["n"] == 0) | (~fits & (p["own"] >= budget)), prompt).otherwise(F.concat(F.when(fits, F.lit("---\n")).otherwise(""), block(p, width), tail))

    return let(let(sections, sized), packed)


def truncate_words(text: Column, most: int) -> Column:
    """Within most bytes, back to a word end where there is one, with an ellipsis if anything was cut."""
    head = truncate_bytes(text, most)
    at_word = F.regexp_extract(head, r"(?s)\A(.*)[ \t\n\f\r]", 1)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.when(head.rlike(r"(?s)[ \t\n\f\r]"), at_word).otherwise(head), F.lit("…")))


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def highlight(snippet: Column, query: Column) -> Column:
    """Escaped snippet with the query's words (two bytes or more) in <mark>, first match first, ties to the earlier word."""
    words = F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda w: F.octet_length(w) > 1)
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(quoted, "|"), F.lit(")"))
    return F.when(F.size(words) > 0, F.regexp_replace(escape_html(snippet), pattern, F.lit("<mark>$1</mark>"))).otherwise(escape_html(snippet))


def url_filename(url: Column) -> Column:
    """What follows the last slash, up to the first question mark."""
    return F.element_at(F.split(F.element_at(F.split(url, "/", -1), -1), r"\?"), 1)


def sanitize_filename(name: Column) -> Column:
    """Last path component without `..`, trimmed; null if nothing is left."""
    last = F.regexp_extract(name, r"(?s)([^/\\]*)\z", 1)
    return F.nullif(F.regexp_replace(F.replace(last, F.lit("..")), r"^\s+|\s+$", ""), F.lit(""))
