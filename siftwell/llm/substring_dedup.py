"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes decides, at word ends only, where a chunk ends; an insertion therefore shifts bytes but not the cuts
that follow it. What is compared, by a 128-bit digest, is a run: the consecutive chunks from each chunk on that make up RUN_WORDS words. So a
passage counts only if it stands in another place as a whole, not if its chunks recur one by one. The first occurrence of a run (smallest document, then
place) always stays whole; words that are in later occurrences of runs only may go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, sized_broadcast, utf8

MASK_BITS = 2  # one word end in four is a cut
LEAST_CHUNK, MOST_CHUNK = 12, 96  # bytes of the normalised text
RUN_WORDS = 24  # words of a run, at least
PIECE = 1 << 20

# The gear table: 256 fixed pseudo-random numbers from a rule, so that every worker has the same.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 2024) for i in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the 16 bytes that end there, by doubling the window four times."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h = h + older
    return h


def cuts(data: bytes) -> np.ndarray:
    """End offsets of the chunks of a normalised text (words joined by single spaces). Chunks have LEAST_CHUNK bytes or more and, unless one word is
    longer, MOST_CHUNK or fewer."""
    ends = []
    for at in range(0, len(data), PIECE):
        begin = max(0, at - 16)
        piece = np.frombuffer(data[begin : at + PIECE], np.uint8)
        spaces = np.flatnonzero(piece == 32)
        spaces = spaces[spaces >= at - begin]
        marks = (gear_hashes(piece)[spaces] >> np.uint32(16 - MASK_BITS)) & np.uint32((1 << MASK_BITS) - 1)
        ends.append(np.stack([spaces + begin + 1, marks == 0], axis=1))
    words = np.concatenate(ends) if ends else np.zeros((0, 2), np.int64)
    out, last, before = [], 0, 0
    for end, marked in words.tolist():
        if end - last > MOST_CHUNK and before > last:
            out.append(before)
            last = before
        if marked and end - last >= LEAST_CHUNK:
            out.append(end)
            last = end
        before = end
    if len(data) > last:
        out.append(len(data))
    return np.array(out, np.int64)


def run_rows(text: bytes | None, run_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(first word, words, upper and lower half of the digest) of the run that begins at each chunk of the lower-cased (A-Z) words of a text."""
    data = b" ".join(text.lower().split()) if text else b""
    ends = cuts(data).tolist()
    begins = [0, *ends][: len(ends)]
    counts = [data.count(b" ", a, e) + (e == len(data)) for a, e in zip(begins, ends, strict=True)]
    word = last = held = 0
    for first, begin in enumerate(begins):
        while last < len(ends) and held < run_words:
            held += counts[last]
            last += 1
        if held < run_words:
            return
        digest = xxhash.xxh3_128_digest(data[begin : ends[last - 1]].rstrip(b" "))
        yield word, held, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
        word += counts[first]
        held -= counts[first]


RUN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("word", pa.int32()), ("words", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])


IDS_BROADCAST = 500_000


def named_texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, text_id, text): every text under a name of its own. text_id is 0 for texts whose id stands at no other text, and a hash of the text for those of other ids and of null ids."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), utf8(text).alias("text"))
    several = rows.groupBy(F.col("doc_id").alias("id")).agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo != hi or id is null").select("id")
    marked = rows.join(sized_broadcast(several, several.count(), IDS_BROADCAST).withColumn("mixed", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return marked.select("doc_id", F.when(F.col("mixed"), F.col("hash")).otherwise(F.lit(0).cast("long")).alias("text_id"), "text")


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """Every run of every row: doc_id, text_id, word, words, high, low."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[int]] = [[] for _ in RUN_SCHEMA]
        for batch in batches:
            for doc, told, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for row in run_rows(body.as_py(), run_words):
                    columns[0].append(doc)
                    columns[1].append(told)
                    for c, v in zip(columns[2:], row, strict=True):
                        c.append(v)
                    if len(columns[0]) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUN_SCHEMA, strict=True)], schema=RUN_SCHEMA)
                        columns = [[] for _ in RUN_SCHEMA]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUN_SCHEMA, strict=True)], schema=RUN_SCHEMA)

    return named_texts(docs, text, key).mapInArrow(expand, "doc_id long, text_id long, word int, words int, high long, low long")


def sections(found: list[tuple[int, int, int, bool]]) -> list[dict]:
    """Passages from the repeated runs (word, words, copies, first) of one document: stretches that some run covers, split where they change between
    staying (a first occurrence covers them) and going."""
    spans = sorted(set(found), key=lambda r: -r[2])
    bounds = np.unique([x for w, n, _, _ in spans for x in (w, w + n)])
    copies, stays = np.zeros(len(bounds), np.int64), np.zeros(len(bounds), bool)
    for word, n, times, first in spans:
        a, b = np.searchsorted(bounds, (word, word + n))
        copies[a:b] = times  # the fewest, as they come last
        stays[a:b] |= first
    out: list[dict] = []
    for k in range(len(bounds) - 1):
        if not copies[k]:
            continue
        joins = out and out[-1]["start"] + out[-1]["words"] == bounds[k]
        width = int(bounds[k + 1] - bounds[k])
        if joins and out[-1]["first"] == stays[k]:
            out[-1]["words"] += width
            out[-1]["copies"] = min(out[-1]["copies"], int(copies[k]))
        else:
            out.append({"start": int(bounds[k]), "words": width, "copies": int(copies[k]), "first": bool(stays[k]), "run": int(out[-1]["run"]) if joins else k})
    for island in {s["run"] for s in out}:
        mine = [s for s in out if s["run"] == island and s["run"] >= 0]
        total = sum(s["words"] for s in mine)
        for s in mine:
            s["run"] = -total
    return [s | {"run": -s["run"]} for s in out]


PASSAGE = "start: int, words: int, copies: long, first: boolean, run: int"


def passages(docs: DataFrame, text: str = "text", key: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """Repeated passages: doc_id, text_id (0, or a hash of the text where the id alone doesn't name one), start and words (position and length in words), copies (fewest occurrences of a run in it), first (it stays here), run (words of
    the whole repeated stretch it is part of).

    Null and empty texts and texts of fewer than run_words words have no runs. An id with several texts is reported for each of them, and so are null ids, which come after all others; rows of
    equal id and text are one text, which stays. Very long texts are cut a piece at a time, whole; the passages of one text are put together in one row. Other columns are not looked
    at, whatever their names. An empty table gives an empty result.
    """

    @F.arrow_udf(f"array<struct<{PASSAGE}>>")
    def merged(words: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("copies", pa.int64()), ("first", pa.bool_()), ("run", pa.int32())]))
        return pa.array([sections([(r["word"], r["words"], r["copies"], r["first"]) for r in found.as_py()]) for found in words], kind)

    every = runs(docs, text, key, run_words)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_id", "word")
    seen = every.groupBy("high", "low").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at")).where("copies > 1")
    # The key of one side is spelled anew, so the join deals out both sides itself and Spark may split a digest that very many runs share.
    seen = seen.select(F.col("high").bitwiseXOR(F.lit(0).cast("long")).alias("s_high"), F.col("low").bitwiseXOR(F.lit(0).cast("long")).alias("s_low"), "copies", "at")
    hits = every.join(seen, (F.col("high") == F.col("s_high")) & (F.col("low") == F.col("s_low")))
    here = F.col("at.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("at.text_id") == F.col("text_id")) & (F.col("at.word") == F.col("word"))
    hits = hits.select("doc_id", "text_id", F.struct("word", "words", "copies", here.alias("first")).alias("run"))
    # Rows that are repeated have the same runs: a set holds them once, in every task before the shuffle.
    return hits.groupBy("doc_id", "text_id").agg(F.collect_set("run").alias("runs")).select("doc_id", "text_id", F.inline(merged("runs")))


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """One row for each document that holds a repeated passage, for each such text if its id has several or is null: doc_id, n_passages, repeated_words, dropped_words, longest_run (words),
    spans (start, words, dropped), text_id. Rows are taken as passages() says."""
    found = passages(docs, text, key, run_words)
    spans = F.array_sort(F.collect_list(F.struct("start", "words", (~F.col("first")).alias("dropped"))))
    told = found.groupBy("doc_id", "text_id").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum("words").alias("repeated_words"), F.sum(F.when(F.col("first"), 0).otherwise(F.col("words"))).alias("dropped_words"), F.max("run").alias("longest_run"), spans.alias("spans")
    )
    return told.select("doc_id", "n_passages", "repeated_words", "dropped_words", "longest_run", "spans", "text_id")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the repeated passages cut out of the text wherever they don't stay. Words left over are joined by single spaces in changed texts; others stay as they were, null and empty ones
    too, as do all other columns, whatever their names. Rows are taken as passages() says: a text is cut by its own passages, whatever else its id stands at; rows that are
    repeated stay, with the same text each. Bytes that are no UTF-8 become replacement characters in changed texts. An empty table gives an empty result."""

    @F.arrow_udf("string")
    def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, spans, strict=True):
            body, gone = t.as_py(), [x for x in s.as_py() or [] if x["dropped"]]
            if body is not None and gone:
                words, last, left = body.split(), 0, []
                for x in gone:
                    left += words[last : x["start"]]
                    last = x["start"] + x["words"]
                body = b" ".join(left + words[last:])
            out.append(None if body is None else body.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    doc, name, spans = (free_name(docs, n) for n in ("doc", "name", "spans"))
    marks = repeated(docs, text, key, run_words).where("dropped_words > 0").select(F.col("doc_id").alias(doc), F.col("text_id").alias(name), F.col("spans").alias(spans))
    joined = docs.join(marks, docs[key].cast("long").eqNullSafe(F.col(doc)) & ((F.col(name) == 0) | (F.col(name) == F.xxhash64(docs[text]))), "left")
    return joined.select(*[F.when(F.col(spans).isNull(), docs[c]).otherwise(cut_out(utf8(docs[c]), F.col(spans))).alias(c) if c == text else docs[c] for c in docs.columns])
