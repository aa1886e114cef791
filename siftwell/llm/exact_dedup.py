"""Exact deduplication by Grace hashing.

Records are hashed to partitions and, inside a partition, spilled to bucket files by further digest bytes until each bucket fits an
open-addressing table, which compares complete contents. A first table in every scan task folds the copies it meets, so a group
that holds a third of all rows crosses the shuffle as one record for each scan task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, cut, free_name, scratch, sized_broadcast, slices, utf8

TABLE_BYTES = 24 << 20  # content that one task's table may hold before it flushes or spills
FAN_OUT = 16  # bucket files of one spill level
DROPPED_BROADCAST = 200_000  # rows to drop, of 48 bytes each, that are broadcast so that documents needn't be dealt out


class Group(NamedTuple):
    digest: bytes  # SHA-256 of the content
    content: bytes  # normalised text
    points: int  # code points of the best original text
    best: int | None  # its id
    rows: int  # rows folded in


def normalise(text: bytes | None) -> bytes:
    """The text without white space; null counts as empty."""
    return (text or b"").translate(None, BLANKS)


def better(points: int, key: int | None, than: Group) -> bool:
    """More code points win, then the smaller id; a null id loses to any other."""
    return (-points, key is None, key or 0) < (-than.points, than.best is None, than.best or 0)


class OpenTable:
    """Linear probing over digest prefixes; a hit needs the complete content to be equal."""

    def __init__(self, slots: int = 1024) -> None:
        self.slots = np.full(slots, -1, np.int64)
        self.groups: list[Group] = []
        self.bytes = 0

    def add(self, g: Group) -> None:
        at = int.from_bytes(g.digest[-8:], "little") & (len(self.slots) - 1)
        while (k := int(self.slots[at])) >= 0:
            old = self.groups[k]
            if old.digest == g.digest and old.content == g.content:
                points, best = (g.points, g.best) if better(g.points, g.best, old) else (old.points, old.best)
                self.groups[k] = Group(old.digest, old.content, points, best, old.rows + g.rows)
                return
            at = (at + 1) & (len(self.slots) - 1)
        self.slots[at] = len(self.groups)
        self.groups.append(g)
        self.bytes += len(g.content) + 160
        if 2 * len(self.groups) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, np.int64)
        for k, g in enumerate(self.groups):
            at = int.from_bytes(g.digest[-8:], "little") & (len(self.slots) - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at] = k


HEAD = struct.Struct("<32sqqqq")


def _put(file, g: Group) -> None:
    file.write(HEAD.pack(g.digest, len(g.content), g.points, -1 if g.best is None else 1, g.rows))
    file.write(struct.pack("<q", g.best or 0))
    file.write(g.content)


def _take(path: str) -> Iterator[Group]:
    with open(path, "rb") as file:
        while head := file.read(HEAD.size):
            digest, size, points, has, rows = HEAD.unpack(head)
            (best,) = struct.unpack("<q", file.read(8))
            yield Group(digest, file.read(size), points, best if has > 0 else None, rows)


def grace(groups: Iterable[Group], table_bytes: int, level: int = 0) -> Iterator[Group]:
    """Merges groups of equal content. What doesn't fit table_bytes goes to bucket files by digest byte `level`, each merged on its own."""
    table, stream = OpenTable(), iter(groups)
    for g in stream:
        table.add(g)
        if table.bytes > table_bytes and level < 31:
            break
    else:
        yield from table.groups
        return
    with scratch(f"grace{level}-") as folder:
        files = [open(f"{folder}/{i}", "wb") for i in range(FAN_OUT)]  # noqa: SIM115
        for part in (table.groups, stream):
            for g in part:
                _put(files[g.digest[level] % FAN_OUT if level % 2 == 0 else g.digest[level] // FAN_OUT], g)
        del table
        for file in files:
            file.close()
        for i in range(FAN_OUT):
            yield from grace(_take(f"{folder}/{i}"), table_bytes, level + 1)


def fold(groups: Iterable[Group], table_bytes: int) -> Iterator[Group]:
    """Map-side folding: a table that is handed on and begun anew whenever it is full."""
    table = OpenTable()
    for g in groups:
        table.add(g)
        if table.bytes > table_bytes:
            yield from table.groups
            table = OpenTable()
    yield from table.groups


PARTIAL = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("points", pa.int64()), ("best", pa.int64()), ("n", pa.int64())])
CLASSES = "digest binary, keep_id long, points long, group_size long"


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each distinct normalised content: digest, keep_id, points (code points of the text that stays), group_size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Group]:
            for batch in batches:
                for k, t, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    content = normalise(t.as_py())
                    yield Group(hashlib.sha256(content).digest(), content, n, k, 1)

        yield from slices(fold(rows(), table_bytes), PARTIAL, weigh=1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Group]:
            for batch in batches:
                columns = batch.columns
                for i in range(batch.num_rows):
                    yield Group(*(c[i].as_py() for c in columns))

        schema = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("points", pa.int64()), ("group_size", pa.int64())])
        yield from slices(((g.digest, g.best, g.points, g.rows) for g in grace(rows(), table_bytes)), schema)

    spelled = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("text"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"))
    partial = spelled.mapInArrow(scan, "digest binary, content binary, points long, best long, n long")
    return partial.repartition("digest").mapInArrow(merge, CLASSES)


@F.arrow_udf(T.BinaryType())
def content_digest(text: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(normalise(t.as_py())).digest() for t in text], pa.binary())


def assign(docs: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. Ties in code points go to the smallest id; null ids come last and are kept
    only where a group has no other. A row repeated under the id that stays is kept each time. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), content_digest(utf8(text)).alias("digest"))
    joined = rows.join(classes(docs, text, key, table_bytes), "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs with one row left of each group of equal texts, all columns as they were, whatever their names.

    Null text counts as empty. Rows are matched by id, digest and code points, so an id that occurs with several texts is safe; of a row repeated under the id that stays one is left.
    Only ids and digests are compared and sorted: whole rows are read where they lie, and moved only if they are repeats or if there are over DROPPED_BROADCAST rows to drop.
    Very long texts are read whole; an empty table gives an empty result.
    """
    mark = free_name(docs, "mark")
    tagged = docs.withColumn(mark, F.struct(F.col(key).cast("long").alias("id"), content_digest(utf8(text)).alias("digest"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points")))
    seen = tagged.groupBy(*[F.col(f"{mark}.{c}").alias(c) for c in ("id", "digest", "points")]).agg(F.count(F.lit(1)).alias("n"))
    best = classes(docs, text, key, table_bytes).select(F.col("keep_id").alias("b_id"), F.col("digest").alias("b_digest"), F.col("points").alias("b_points"), F.lit(True).alias("stays"))
    match = F.col("id").eqNullSafe(F.col("b_id")) & (F.col("digest") == F.col("b_digest")) & (F.col("points") == F.col("b_points"))
    told = seen.join(best, match, "left").select("id", "digest", "points", F.col("stays").isNotNull().alias("stays"), "n")
    told = cut(told.where("not stays or n > 1"))
    sizes = {r["stays"]: r["rows"] for r in told.groupBy("stays").agg(F.count(F.lit(1)).alias("rows")).collect()}

    def at(rows: DataFrame, stays: bool, how: str) -> DataFrame:
        few = told.where(F.col("stays") == stays).select(F.col("id").alias("t_id"), F.col("digest").alias("t_digest"), F.col("points").alias("t_points"))
        same = rows[mark]["id"].eqNullSafe(few["t_id"]) & (rows[mark]["digest"] == few["t_digest"]) & (rows[mark]["points"] == few["t_points"])
        return rows.join(sized_broadcast(few, sizes[stays], DROPPED_BROADCAST), same, how)

    left = at(tagged, False, "left_anti") if False in sizes else tagged
    if True in sizes:
        left = at(left, True, "left_anti").unionByName(at(left, True, "left_semi").dropDuplicates([mark]))
    return left.drop(mark)
