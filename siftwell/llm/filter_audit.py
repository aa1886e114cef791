"""Audit of how five text filters work on each other, in every order of them.

Duplicates are found by sorting: rows are range-sorted by text fingerprint, text and id, and each is compared with the one before it. What a filter order
keeps or removes depends only on how many rows fail which filters, so the rows are folded into additive counters of failure masks; all 120 orders are read
off the 32 counters of a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, settings_kept, sized_broadcast, use_small_batches

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 50, 65, 5, b"#$%&*|"
EDGES_BROADCAST = 200_000  # texts at the ends of partitions, of 48 bytes each
PIECE = 1 << 20

_UPPER, _INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_BLANK = tuple(b" \t\n\x0b\x0c\r")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words, so that no list of a very long text's words is held."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        yield text[at:end]
        at = end


def failures(text: bytes) -> int:
    """Mask of the failed filters A to D of a whole text; bit k is the k-th letter of FILTERS. A null text counts as empty, which fails A only."""
    words, distinct = 0, set()
    for piece in _pieces(text):
        found = piece.split()
        words += len(found)
        distinct.update(found)
    upper, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _INNER))
    return (words < LEAST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * words) << 1 | (100 * upper > MOST_UPPER * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


_ROWS = "edge boolean, doc_id long, part string, mask int, digest binary, least long"
_ARROW = pa.schema([("edge", pa.bool_()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary()), ("least", pa.int64())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with their masks. A row whose fingerprint is the partition's first one may have copies in partitions before: it carries its text's digest. The
    texts of the last fingerprint, and the smallest id of each, follow as edges for the partitions after."""
    first = last = None
    texts: list[list] = []  # of the fingerprint at hand, sorted: text, smallest id, digest or None, mask
    for batch in batches:
        out: list[tuple] = []
        for fp, text, doc_id, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if fp != last or not texts:
                texts = []
                first, last = fp if first is None else first, fp
            if not texts or texts[-1][0] != text:
                texts.append([text, None, hashlib.sha256(text).digest() if fp == first else None, failures(text)])
            known = texts[-1]
            if known[1] is None:
                known[1] = doc_id
            copy = doc_id is not None and known[1] < doc_id
            out.append((False, doc_id, part, known[3] | copy << 4, known[2], None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW, strict=True)], schema=_ARROW)
    edges = [(True, None, None, None, digest or hashlib.sha256(text).digest(), least) for text, least, digest, _ in texts if least is not None]
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*edges), _ARROW, strict=True)], schema=_ARROW)


def failure_masks(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, part, mask (bit k: the k-th of FILTERS fails).

    The range partitioning is by fingerprint and id, so copies of one text, a third of all rows say, are spread over many partitions and only 64-bit keys are
    sampled; inside a partition texts are compared in full, between partitions by SHA-256.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.xxhash64(body).alias("fp"), body.alias("body"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    # The row number only deals out rows that are equal in all else.
    dealt = rows.withColumn("k", F.monotonically_increasing_id()).repartitionByRange("fp", "id", "k").sortWithinPartitions("fp", "body", "id")
    with settings_kept(spark):
        use_small_batches(spark)
        seen = cut(dealt.select("fp", "body", "id", "part").mapInArrow(_compared, _ROWS))
    before = seen.where("edge").groupBy("digest").agg(F.min("least").alias("before"))
    edges = sized_broadcast(before, seen.where("edge").count(), EDGES_BROADCAST)
    copy = F.coalesce(F.col("before") < F.col("doc_id"), F.lit(False))
    return seen.where("not edge").join(edges, "digest", "left").select("doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask) with the numbers of rows, of rows whose label quality is 1, and of rows whose label toxic is 1. An id labelled twice counts once, as labelled if any of its labels is 1."""
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("bad"))


def _steps() -> Column:
    """Every order and step as a struct: the order, the step, the filter's bit and the bits of the filters before it."""
    told = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            told.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {step}, 'bit', {bit}, 'before', {before})")
            before |= bit
    return F.expr(f"array({', '.join(told)})")


def orders(counted: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the counters: documented at audit()."""
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))  # 32 at most
    at = cells.select("part", "cells", F.explode(_steps()).alias("s")).select("part", "cells", "s.*")

    def total(test: str, value: str = "c.n") -> Column:
        return F.expr(f"aggregate(cells, 0L, (a, c) -> a + IF({test}, {value}, 0L))")

    here = "(c.mask & before) = 0 AND (c.mask & bit) != 0"
    return at.select(
        "part", "filter_order", "step", total("(c.mask & (before | bit)) = 0").alias("kept"), total(here).alias("removed"), total("(c.mask & before) != 0 AND (c.mask & bit) != 0").alias("redundant"),
        total("c.mask = bit").alias("unique_fails"), total(here, "c.good").alias("good_lost"), total(here, "c.bad").alias("toxic_lost"),
        # Of a row that fails k filters, each of them comes first in 120 / k orders.
        total("(c.mask & bit) != 0", "c.n * (120 div bit_count(c.mask))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """What each filter does at each step of each order of the filters, for each part.

    A: under 50 words; B: under 65 % distinct words; C: over 5 % A-Z; D: any of #$%&*|; E: equal to the text of a smaller id of the whole table. Columns: part, filter_order,
    step, kept (after the step), removed (at it), redundant (fails its filter, gone before), unique_fails (fails no other), good_lost, toxic_lost (removed here and so labelled), shapley
    (removed by the filter, summed over all orders).

    Null texts count as empty and are equal to empty ones; a null part is the empty string. A row with a null id fails E never and makes no other row fail it; equal rows with
    equal ids don't fail E. Rows that are repeated count each. Very long texts are read whole, a piece at a time. An empty table gives an empty result. Other columns are not looked
    at, whatever their names.
    """
    return orders(counters(failure_masks(docs, text, key, part), labels, key))
