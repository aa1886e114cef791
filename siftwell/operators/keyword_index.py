"""A BM25 index on disk that is kept up to date and read in part.

Chunks are added in segments. A task deals the chunks that it reads to slots and inverts a slot at once, so postings are never rows by themselves: a block holds the places of one term in one slot, with the largest
count and the smallest length among them, enough for an upper bound of what the term can give any chunk of the slot. What a slot's places are (chunk, document, length) is written once for the slot. Blocks lie in parts
by the hash of their term, so a search reads the parts of its terms, and of those only the slots whose bounds, added up over the query's terms, reach the score of the k-th best chunk of a few promising slots. Deleted
chunks leave their places as tombstones until segments are merged. All relations of an index change in one transaction of a snapshot store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from ..sources.snapshots import Store, Transaction
from . import search
from .search import K1, B, ranked, tokens, top

PARTS = 64
SLOT_CHUNKS = 4096  # chunks of a slot, at most; a place has 15 bits
SEED_SLOTS = 4  # slots of a query that are read for its threshold
TERMS_LISTED = 2_000  # terms that a scan may be told one by one
TERMS_BROADCAST = 100_000
DEAD_BROADCAST = 20_000_000  # tombstones that may be broadcast, at two bytes or less
MERGE_AT = 8  # segments from which upkeep merges them

_SUMMARY = ("term", "segment", "slot", "n", "most_tf", "least_dl")
_SLOT = "slot long, term string, n int, most_tf int, least_dl int, places binary, tfs binary, chunk_ids array<bigint>, document_ids array<bigint>, dls array<int>"


def _part(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def share(tf: Column, dl: Column, mean: float) -> Column:
    """The part of a BM25 score that count and length make: it grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def _words(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), tokens(F.coalesce("content", F.lit(""))).alias("words"))


def _inverted(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (chunk_id, document_id, words): of each slot of so many rows its head, a row without a term that says what its places are, and a row for each term."""
    mark = uuid.uuid4().int % (1 << 24)  # two writers at once may have the same segment

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = (mark << 39) + (TaskContext.get().partitionId() << 19)
        waiting: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            waiting = pa.concat_tables([waiting, rows]) if waiting else rows
            while len(waiting) >= size:
                yield of_slot(slot, waiting.slice(0, size))
                waiting, slot = waiting.slice(size), slot + 1
        if waiting:
            yield of_slot(slot, waiting)

    def of_slot(slot: int, table: pa.Table) -> pa.RecordBatch:
        table, n = table.combine_chunks(), len(table)
        lists = table.column("words").chunk(0)
        dls, words = np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()
        keys = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), dls)
        keys.sort()
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        term, place = np.divmod(keys[at], n)
        tfs, begin = np.diff(at, append=len(keys)), np.flatnonzero(np.diff(term, prepend=-1))
        terms = len(begin)
        most = np.maximum.reduceat(tfs, begin) if terms else []
        least = np.minimum.reduceat(dls[place], begin) if terms else []
        first = lambda x, kind: pa.array(np.concatenate([[0], x]).astype(kind))
        heads, none = pa.array(np.concatenate([[0], np.full(terms + 1, n)]).astype(np.int32)), pa.array([b""], pa.binary())
        places, counts = search.packed(place, tfs, begin)
        lists_of = lambda x: pa.ListArray.from_arrays(heads, x)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(terms + 1, slot)), pa.concat_arrays([pa.array([None], pa.string()), words.dictionary.cast(pa.string())]), first(np.diff(begin, append=len(place)), np.int32), first(most, np.int32), first(least, np.int32),
                pa.concat_arrays([none, places]), pa.concat_arrays([none, counts]),
                lists_of(table.column("chunk_id").chunk(0)), lists_of(table.column("document_id").chunk(0)), lists_of(pa.array(dls.astype(np.int32))),
            ],
            names=["slot", "term", "n", "most_tf", "least_dl", "places", "tfs", "chunk_ids", "document_ids", "dls"],
        )

    return invert


def _opened(blocks: DataFrame, *kept: str) -> DataFrame:
    """The kept columns of blocks with place and tf, a row for each posting."""
    rows = blocks.select(*kept, "places", "tfs")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, place, tf = search.unpacked(batch.column("places"), batch.column("tfs"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            for at in range(0, len(row), 100_000):
                part = slice(at, at + 100_000)
                told = batch.select(list(kept)).take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays([*told.columns, pa.array(place[part].astype(np.int32)), pa.array(tf[part].astype(np.int32))], names=[*kept, "place", "tf"])

    return rows.mapInArrow(opened, T.StructType([*rows.schema.fields[: len(kept)], T.StructField("place", T.IntegerType()), T.StructField("tf", T.IntegerType())]))


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, lost) of blocks (term, places, dead): how many of the places are dead."""
    for batch in batches:
        sizes, place, _ = search.unpacked(batch.column("places"))
        lengths, words = search._sizes(batch.column("dead")), batch.column("dead").flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        known = np.flatnonzero(place // 64 < lengths[row])
        row, place = row[known], place[known]
        bits = words[(np.cumsum(lengths) - lengths)[row] + place // 64] >> (place % 64) & 1
        lost = np.bincount(row, weights=bits, minlength=len(sizes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(lost)], names=["term", "lost"])


class Index:
    """An index under a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    # --- upkeep

    def _add(self, t: Transaction, segment: int, slots: DataFrame, how: str = "append") -> None:
        """Writes slots, as _inverted gives them, as one segment: one shuffle of its blocks. A part is dealt to four tasks by slot."""
        put = t.append if how == "append" else t.replace
        blocks = slots.where("term is not null").select("term", F.lit(segment).alias("segment"), "slot", "n", "most_tf", "least_dl", "places", "tfs", _part("term").alias("p"))
        put("blocks", blocks.repartition("p", F.pmod("slot", F.lit(4))).sortWithinPartitions("p", "term", "slot"), F.col("p"), dealt=True)
        heads = slots.where("term is null").select(F.lit(segment).alias("segment"), "slot", "chunk_ids", "document_ids", "dls")
        put("chunks", heads)
        put("stats", heads.agg(F.lit(segment).alias("segment"), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).cast("long").alias("words")))

    def _bury(self, t: Transaction, segment: int, lost: DataFrame) -> None:
        """Tombstones for places (segment, slot, place, dl)."""
        lost = shared.cut(lost.select("segment", "slot", "place", "dl"))
        if lost.isEmpty():
            return
        t.append("gone", lost.groupBy("segment", "slot").agg(F.collect_list(F.col("place").cast("short")).alias("places")))
        t.append("stats", lost.agg(F.lit(segment).alias("segment"), (-F.count(F.lit(1))).alias("n"), (-F.sum("dl")).cast("long").alias("words")))

    def _dead(self, t: Transaction) -> DataFrame:
        """(segment, slot, dead): the places of a slot whose chunks are gone, as the bits of whole numbers."""
        places = t.read("gone").select("segment", "slot", F.explode("places").alias("place"))
        words = places.groupBy("segment", "slot", F.expr("place div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits"))
        by_word = words.groupBy("segment", "slot").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("bits"), F.max("w").alias("last"))
        return by_word.select("segment", "slot", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("bits", i), F.lit(0).cast("long"))).alias("dead"))

    @staticmethod
    def _is_dead() -> Column:
        """Whether the chunk at place is gone, of rows with dead."""
        return F.expr("coalesce((shiftrightunsigned(get(dead, cast(place div 64 AS int)), cast(place % 64 AS int)) & 1L) = 1L, false)")

    def _with_dead(self, t: Transaction, rows: DataFrame, how: str) -> DataFrame:
        few = (t.read("gone").agg(F.sum(F.size("places")).alias("n")).first()["n"] or 0) <= DEAD_BROADCAST
        return rows.join(F.broadcast(self._dead(t)) if few else self._dead(t), ["segment", "slot"], how)

    @staticmethod
    def _places(heads: DataFrame) -> DataFrame:
        """(segment, slot, place, chunk_id, document_id, dl) of heads of slots."""
        kept = [c for c in ("dead",) if c in heads.columns]
        rows = heads.select("segment", "slot", *kept, F.posexplode(F.arrays_zip("chunk_ids", "document_ids", "dls")).alias("place", "x"))
        return rows.select("segment", "slot", "place", *kept, F.col("x.chunk_ids").alias("chunk_id"), F.col("x.document_ids").alias("document_id"), F.col("x.dls").alias("dl"))

    def _live(self, t: Transaction) -> DataFrame:
        """(segment, slot, place, chunk_id, document_id, dl) of all live chunks."""
        if not t.has("gone"):
            return self._places(t.read("chunks"))
        return self._places(self._with_dead(t, t.read("chunks"), "left")).where(~self._is_dead()).drop("dead")

    def update(self, add: DataFrame | None = None, remove: DataFrame | None = None, writer: str | None = None, batch: int | None = None) -> int:
        """Chunks (document_id, chunk_id, content) added, in place of those with the same ids, and chunks (chunk_id) removed. One row of an id is taken. Repeating a writer's batch changes nothing."""
        t = self.store.begin()
        if writer is not None and batch is not None and t.base["writers"].get(writer, -1) >= batch:
            return t.base["number"]
        work = f"_work/{uuid.uuid4().hex}"
        try:
            return self._update(t, add, remove, work, writer, batch)
        finally:
            self._clear(work)

    def _update(self, t: Transaction, add: DataFrame | None, remove: DataFrame | None, work: str, writer: str | None, batch: int | None) -> int:
        segment = t.base["number"] + 1
        new = None
        if add is not None:
            slots = self._set_down(_words(add), work)
            new = self._places(slots.where("term is null").withColumn("segment", F.lit(segment)))
        if t.has("chunks"):
            ids = [x.select("chunk_id") for x in (new, remove) if x is not None]
            for x in ids[1:]:
                ids[0] = ids[0].unionByName(x)
            self._bury(t, segment, self._live(t).join(ids[0].distinct(), "chunk_id", "left_semi"))
        if new is not None:
            self._add(t, segment, slots)
            met = new.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("slot", "place")).alias("kept")).where("n > 1")
            if not (twins := shared.cut(met)).isEmpty():
                self._bury(t, segment, new.join(twins, "chunk_id").where(F.struct("slot", "place") != F.col("kept")))
        if not t.changes:
            return t.base["number"]
        return t.commit(writer, batch)

    def _set_down(self, words: DataFrame, work: str) -> DataFrame:
        """The slots of rows (chunk_id, document_id, words), computed once, from compressed files that go with _clear."""
        path = f"{self.store.root}/{work}"
        words.mapInArrow(_inverted(SLOT_CHUNKS), _SLOT).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(_SLOT).parquet(path)

    def _clear(self, work: str) -> None:
        self.store._fs.delete(self.store._path(work), True)

    def merge(self) -> int:
        """All segments as one without what was removed. Another writer's update meanwhile makes it a Conflict, and the index stays as it was."""
        t = self.store.begin()
        bags = self._postings(t).groupBy("chunk_id").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("words"))
        whole = self._live(t).select("chunk_id", "document_id").join(bags, "chunk_id", "left").select("chunk_id", "document_id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
        work = f"_work/{uuid.uuid4().hex}"
        try:
            self._add(t, t.base["number"] + 1, self._set_down(whole, work), "replace")
            if t.has("gone"):
                t.replace("gone", t.read("gone").limit(0))
            return t.commit()
        finally:
            self._clear(work)

    def upkeep(self) -> bool:
        """Merges once there are MERGE_AT segments."""
        t = self.store.begin()
        many = t.has("stats") and t.read("stats").where("n >= 0").count() >= MERGE_AT
        if many:
            self.merge()
        return many

    # --- reading

    def _postings(self, t: Transaction) -> DataFrame:
        """(term, document_id, chunk_id, dl, tf) of all live chunks."""
        rows = _opened(t.read("blocks"), "term", "segment", "slot")
        return rows.join(self._live(t), ["segment", "slot", "place"]).select("term", "document_id", "chunk_id", "dl", "tf")

    def postings(self) -> DataFrame:
        """(term, document_id, chunk_id, dl, tf) of all live chunks, each with a row of the empty term: what search.bm25 takes."""
        t = self.store.begin()
        lengths = self._live(t).select(F.lit("").alias("term"), "document_id", "chunk_id", "dl", F.lit(1).alias("tf"))
        return self._postings(t).unionByName(lengths)

    def _weights(self, t: Transaction, queries: DataFrame) -> tuple[DataFrame, DataFrame, bool, float] | None:
        """Query terms with their idf, the blocks of those terms, whether there are tombstones, and the mean length. None if there are no chunks or no terms."""
        if not t.has("stats"):
            return None
        stat = t.read("stats").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        if not stat["n"]:
            return None
        asked = shared.cut(queries.select("query_id", F.explode(F.array_distinct(tokens(F.regexp_replace("text", "['\"]", " ")))).alias("term")))
        terms = asked.select("term").distinct()
        few = terms.withColumn("p", _part("term")).limit(TERMS_LISTED + 1).collect()
        if not few:
            return None
        parts = sorted({r["p"] for r in few}) if len(few) <= TERMS_LISTED else None

        blocks, gone = t.read("blocks", parts), t.has("gone")
        if parts is not None:
            blocks = blocks.where(F.col("term").isin([r["term"] for r in few]))
        else:
            terms = shared.cut(terms)
            blocks = blocks.join(F.broadcast(terms) if terms.count() <= search.PASS_TERMS else terms, "term", "left_semi")
        counts = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        if gone:
            met = self._with_dead(t, blocks.select("term", "segment", "slot", "places"), "inner").select("term", "places", "dead")
            lost = met.mapInArrow(_lost, "term string, lost long").groupBy("term").agg(F.sum("lost").alias("lost"))
            counts = counts.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
        idf = F.log(1 + (F.lit(float(stat["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = shared.cut(asked.join(counts, "term").where("df > 0").select("query_id", "term", idf.alias("idf")))
        return weights, blocks, gone, float(stat["words"]) / stat["n"]

    def _scored(self, t: Transaction, picked: DataFrame, blocks: DataFrame, mean: float) -> DataFrame:
        """Scores of the chunks of picked (query_id, term, idf, segment, slot)."""
        rows = _opened(blocks.join(picked, ["term", "segment", "slot"]), "query_id", "idf", "segment", "slot")
        met = rows.join(self._live(t).join(picked.select("segment", "slot").distinct(), ["segment", "slot"], "left_semi"), ["segment", "slot", "place"])
        return met.groupBy("query_id", "document_id", "chunk_id").agg(F.sum(F.col("idf") * share(F.col("tf"), F.col("dl"), mean)).alias("score"))

    def _by_slot(self, t: Transaction, blocks: DataFrame) -> DataFrame:
        """The blocks with the heads of all slots, as search.scan takes them."""
        heads = self._with_dead(t, t.read("chunks"), "left") if t.has("gone") else t.read("chunks").withColumn("dead", F.lit(None).cast("array<bigint>"))
        return blocks.select("segment", "slot", "term", "places", "tfs").unionByName(heads, allowMissingColumns=True)

    def _bounds(self, weights: DataFrame, blocks: DataFrame, mean: float) -> DataFrame:
        """(query_id, segment, slot, bound): no chunk of the slot has a larger score."""
        small = weights.count() <= TERMS_BROADCAST
        met = blocks.select(*_SUMMARY).join(F.broadcast(weights) if small else weights, "term")
        return met.groupBy("query_id", "segment", "slot").agg(F.sum(F.col("idf") * share(F.col("most_tf"), F.col("least_dl"), mean)).alias("bound"))

    def slots(self, queries: DataFrame, limit: int) -> DataFrame:
        """(query_id, segment, slot, bound, least): the slots that a search for the best limit chunks reads, and the score that a chunk must reach."""
        t = self.store.begin()
        found = self._weights(t, queries)
        if found is None:
            return self.spark.createDataFrame([], "query_id long, segment int, slot long, bound double, least double")
        weights, blocks, _, mean = found
        return self._kept(t, weights, blocks, mean, limit)

    def _kept(self, t: Transaction, weights: DataFrame, blocks: DataFrame, mean: float, limit: int) -> DataFrame:
        bounds = shared.cut(self._bounds(weights, blocks, mean))
        seeds = top(bounds, SEED_SLOTS, [F.col("bound").desc(), F.col("segment"), F.col("slot")])
        scores = self._scored(t, seeds.select("query_id", "segment", "slot").join(weights, "query_id"), blocks, mean)
        least = top(scores, limit, [F.col("score").desc(), F.col("chunk_id")]).where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
        return bounds.join(least, "query_id", "left").where("least is null or bound >= least - 1e-6")

    def search(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """query_id, document_id, chunk_id, score, rank of queries (query_id, text), as search.bm25. Without a limit every slot of the terms is read. Few queries read the slots whose bounds
        reach their scores; many are scored in one scan of the slots, as the bounds of each query and slot would be as many as the scores of each query and chunk by far too soon."""
        t = self.store.begin()
        found = self._weights(t, queries)
        if found is None:
            return self.spark.createDataFrame([], "query_id long, document_id long, chunk_id long, score double, rank int")
        weights, blocks, _, mean = found
        order = [F.round("score", 9).desc(), F.col("chunk_id")]
        if limit and weights.select("query_id").distinct().limit(search.FEW_QUERIES + 1).count() > search.FEW_QUERIES:
            return top(search.scan(self._by_slot(t, blocks), weights, mean, limit), limit, order)
        kept = self._bounds(weights, blocks, mean) if limit is None else shared.cut(self._kept(t, weights, blocks, mean, limit))
        scored = self._scored(t, kept.select("query_id", "segment", "slot").join(weights, "query_id"), blocks, mean)
        return top(scored, limit, order) if limit else ranked(scored, ["query_id"], order)
