"""Token counts by offset-mapped attribution.

Each document is encoded once, whole. Token byte spans follow from the tokens' own lengths (a byte-level token may end inside a character, so bytes are what spans are
counted in) and are joined to the document's sections by interval; the sections are told in characters as well. A token inside one section belongs to it, and one that crosses a boundary is given away by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that goes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "end")
OUT = pa.list_(pa.struct([("section", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("first_char", pa.int64()), ("last_char", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("of_document", pa.int64())]))


@cache
def _encoder(path: str):
    """The encoding and the byte length of each token, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("siftwell", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ends(body: bytes, path: str = RANKS) -> np.ndarray:
    """Byte offsets at which the tokens of a whole text end. Byte-level pieces lose nothing, so the last one is the text's length. A byte that is no UTF-8 is
    encoded as U+FFFD and keeps its own one byte of the text."""
    encoder, lengths = _encoder(path)
    text = body.decode("utf-8", "surrogateescape")
    if text.isprintable() or not any("\udc80" <= c <= "\udcff" for c in text):
        ids = encoder.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        return np.cumsum(lengths[ids])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    odd = (codes >= 0xDC80) & (codes <= 0xDCFF)
    shown = np.where(odd, 0xFFFD, codes).astype(np.uint32)
    width = np.where(shown < 0x80, 1, np.where(shown < 0x800, 2, np.where(shown < 0x10000, 3, 4)))
    ids = encoder.encode_to_numpy(shown.tobytes().decode("utf-32-le"), allowed_special=set(), disallowed_special=())
    of = np.repeat(np.arange(len(codes)), width)  # character of each byte as encoded
    into = np.arange(len(of)) - (np.cumsum(width) - width)[of] + 1
    own = np.where(odd, 1, width)
    upto = np.concatenate([[0], (np.cumsum(own) - own)[of] + np.minimum(into, own[of])])
    return upto[np.cumsum(lengths[ids])]


def attribute(ends: np.ndarray, starts_of_sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section. Sections are given by their sorted first byte and reach to the next one.

    start: the section of a token's first byte; end: of its last byte; majority: the one with most of its bytes, ties to the earlier.
    """
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(starts_of_sections, begin, side="right") - 1
    last = np.searchsorted(starts_of_sections, ends - 1, side="right") - 1
    owner = {"start": first, "end": last}.get(rule)
    crossing = first != last
    if owner is None:
        owner = first.copy()
        bounds = np.append(starts_of_sections, ends[-1] if len(ends) else 0)
        for i in np.flatnonzero(crossing):
            own = np.arange(first[i], last[i] + 1)
            shares = np.minimum(ends[i], bounds[own + 1]) - np.maximum(begin[i], bounds[own])
            owner[i] = own[int(shares.argmax())]
    n = len(starts_of_sections)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def line_sections(data: bytes) -> np.ndarray:
    """First bytes of the non-empty lines; a line end belongs to the line before it, leading line ends to the first line."""
    b = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], b[:-1] == 10]) & (b != 10)) if len(b) else np.zeros(0, np.int64)
    if len(b) and (not len(starts) or starts[0] != 0):
        starts = np.concatenate([[0], starts[1:]])
    return starts.astype(np.int64)


def sections(text: Column, path: str = RANKS, rule: str = "start", bounds: Column | None = None) -> Column:
    """array<struct<section, first, last, first_char, last_char, n_tokens, n_crossing, of_document>> of a text; first and last are byte offsets. bounds: sorted first bytes of the
    sections (null or none: the whole text is one); by default the sections are the lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def one(body: bytes | None, given: list | None, by_line: bool) -> list[dict]:
        if not body:
            return []
        starts = line_sections(body) if by_line else np.unique(np.array([0, *(x for x in given or [] if x is not None and 0 < x < len(body))], np.int64))
        counts, crossing = attribute(token_ends(body, path), starts, rule)
        ends = np.append(starts[1:], len(body))
        total = int(counts.sum())
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)])
        return [{"section": k, "first": int(a), "last": int(e), "first_char": int(chars[a]), "last_char": int(chars[e]), "n_tokens": int(n), "n_crossing": int(c), "of_document": total} for k, (a, e, n, c) in enumerate(zip(starts, ends, counts, crossing, strict=True))]

    kind = "array<struct<section: int, first: long, last: long, first_char: long, last_char: long, n_tokens: long, n_crossing: long, of_document: long>>"

    def rows(texts: pa.Array, given: Iterator | None) -> pa.Array:
        return pa.array([one(t.as_py(), g, given is None) for t, g in zip(texts, given if given is not None else [None] * len(texts), strict=True)], OUT)

    if bounds is None:

        @F.arrow_udf(kind)
        def lines(texts: pa.Array) -> pa.Array:
            return rows(texts, None)

        return lines(text.cast("binary"))

    @F.arrow_udf(kind)
    def told(texts: pa.Array, given: pa.Array) -> pa.Array:
        return rows(texts, given.to_pylist())

    return told(text.cast("binary"), bounds.cast("array<long>"))


def count(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = RANKS, rule: str = "start", bounds: str | None = None) -> DataFrame:
    """One row for each section of each row of docs: doc_id, section, first, last (bytes), first_char, last_char, n_tokens, n_crossing, of_document (tokens of the whole document).

    Null and empty texts have no sections and no rows. A row with a null id keeps it; repeated rows are counted each; very long texts are encoded whole, one at a time; bytes that
    are no UTF-8 count as U+FFFD; other columns are not looked at, whatever their names; an empty table gives an empty result. The tokens of a document's sections sum to of_document whatever the rule.
    """
    found = free_name(docs, "found")
    told = docs.select(F.col(key).alias("doc_id"), sections(F.col(text), path, rule, F.col(bounds) if bounds else None).alias(found))
    # The outer form keeps Spark from adding a filter on the sections below, which would encode every document twice.
    return told.select("doc_id", F.inline_outer(found)).where("section is not null")
