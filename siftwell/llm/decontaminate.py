"""Benchmark decontamination in DataFrame functions only.

Every benchmark item is held against windows of its own length in words. Items and windows get a SimHash fingerprint over their weighted shingles (a weight is
a shingle's count). A multi-index over eight 8-bit blocks finds every window within Hamming radius 23 of an item of that length: some
block then differs in at most two bits, and an item stands in the index under all such block values. Candidates are verified by the exact
weighted Jaccard similarity of their shingles.

Fingerprinting every window of every length would cost documents x lengths, so windows are thinned first, without loss. Call a shingle of a document marked
for a length if it stands in an item of that length.

* Two sets of m shingles have a weighted Jaccard similarity of t only with 2tm / (1 + t) or more in common, so a window needs so many marked shingles.
* A window that begins with an unmarked shingle can move on by one: what it loses counts for no item, so no similarity falls. Windows that begin
  with a marked shingle are enough, with the last window of the document, which can't move. This holds for repeated shingles too.
* If the shingle that leaves is the one that enters, the next window has the same weights, and the first of the two is enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, sized_broadcast

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_ERRORS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1
MARKS_BROADCAST = 1_000_000  # distinct shingles of the benchmark (about 40 bytes each) up to which they are broadcast
INDEX_BROADCAST = 1_000_000  # rows of the Hamming index (296 for each item)
TEXTS_BROADCAST = 500_000  # digests of texts with windows
LANES = 32  # counters of a fingerprint: 32 longs of two 32-bit fields


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def text_digest(text: str) -> Column:
    """By which equal texts are one: they are looked at once, and rows without an id are found as well."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _shingles(ws: Column, k: Column) -> Column:
    """Shingles of k words as text; fewer words than k: none."""
    last = F.size(ws) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(ws, i + 1, k), " "))).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def simhash(shingles: Column) -> Column:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes. A fold over the packed counters of all hashes."""
    fields = F.lit(0x0000000100000001)

    def bit(counted: Column, k: Column, j: int, n: Column) -> Column:
        ones = F.shiftrightunsigned(counted, LANES * j).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(2 * ones > n, F.call_function("shiftleft", F.lit(1).cast("long"), k + LANES * j)).otherwise(F.lit(0).cast("long"))

    def lane_bits(hashes: Column, k: Column) -> Column:
        counted = F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + F.call_function("shiftrightunsigned", h, k).bitwiseAND(fields))
        return _let(counted, lambda c: bit(c, k, 0, F.size(hashes)).bitwiseOR(bit(c, k, 1, F.size(hashes))))

    def whole(hashes: Column) -> Column:
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: lane_bits(hashes, k)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return _let(F.transform(shingles, lambda s: F.xxhash64(s)), whole)


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def blocks(fp: Column) -> Column:
    """(block, value) of the eight blocks of a fingerprint, written out so that nothing about them is inferred below a join."""
    return F.array(*[F.struct(F.lit(b).alias("block"), _block(fp, b).alias("value")) for b in range(BLOCKS)])


def first_block(difference: Column) -> Column:
    """The first block within BLOCK_ERRORS bits: a pair that meets in several blocks is taken in this one only."""
    return F.coalesce(*[F.when(F.bit_count(_block(difference, b)) <= BLOCK_ERRORS, F.lit(b)) for b in range(BLOCKS)])


def _shingle_hash(h: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(h), at + i) for i in range(k)])


def _needed(m: Column, other: Column, similarity: float) -> Column:
    """Shingles that multisets of m and other shingles have in common, at least, if they are similar."""
    return F.ceil(similarity * (m + other) / (1 + similarity) - 1e-9).cast("int")


def _starts(texts: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    """(digest, n, starts): where the windows of n words begin that are to be looked at. items: those with one shingle length k."""
    hashed = items.select("n", F.transform("ws", lambda w: F.xxhash64(w)).alias("h"))
    marks = cut(hashed.select("n", "h", F.posexplode("h").alias("o", "w")).where(F.col("o") + k <= F.col("n")).select("n", _shingle_hash("h", F.col("o"), k).alias("shingle")).distinct())
    marks = sized_broadcast(marks, marks.count(), MARKS_BROADCAST)
    spread = texts.select("digest", F.transform("ws", lambda w: F.xxhash64(w)).alias("h")).select("digest", "h", F.posexplode("h").alias("p", "w")).where(F.col("p") + k <= F.size("h"))
    hits = spread.select("digest", "h", "p", _shingle_hash("h", F.col("p"), k).alias("shingle")).join(marks, "shingle")
    m = F.col("n") - k + 1
    enters = F.col("p") - 1 + m
    same = (F.col("p") > 0) & (enters + k <= F.size("h")) & (_shingle_hash("h", F.col("p") - 1, k) == _shingle_hash("h", enters, k))
    found = hits.select("digest", "n", F.size("h").alias("words"), F.struct("p", same.alias("same")).alias("at")).groupBy("digest", "n").agg(F.array_sort(F.collect_set("at")).alias("at"), F.first("words").alias("words"))
    last, need = F.col("words") - F.col("n"), _needed(m, m, similarity)
    at, size = F.col("at"), F.size("at")

    def begins(x: Column, i: Column) -> Column:
        full = F.get(at, i + need - 1)["p"] <= x["p"] + m - 1
        again = x["same"] & (F.get(at, F.greatest(i - 1, F.lit(0)))["p"] == x["p"] - 1)
        return F.when((x["p"] <= last) & F.coalesce(full, F.lit(False)) & ~again, x["p"])

    inner = F.filter(F.transform(at, begins), lambda p: p.isNotNull())
    short = _needed(m, F.col("words") - k + 1, similarity)
    outer = F.when(last < 0, F.when(size >= short, F.array(F.lit(0)))).when((size >= need) & (F.get(at, F.greatest(size - need, F.lit(0)))["p"] >= last), F.array(last))
    starts = F.when(last < 0, F.array().cast("array<int>")).otherwise(inner)
    return found.select("digest", "n", F.array_distinct(F.concat(starts, F.coalesce(outer, F.array().cast("array<int>")))).alias("starts")).where(F.size("starts") > 0)


def _counted(rows: DataFrame, *ids: str) -> DataFrame:
    return rows.select(*ids, F.explode("shingles").alias("shingle")).groupBy(*ids, "shingle").agg(F.count(F.lit(1)).alias("times"))


def _similar(docs: DataFrame, items: DataFrame, k: int, text: str, similarity: float) -> DataFrame:
    """(digest, item_id, start, n_words, hamming, similarity) of the windows that reach the similarity."""
    texts = docs.select(text_digest(text).alias("digest"), F.col(text).alias("body"))
    starts = cut(_starts(texts.select("digest", words(F.col("body")).alias("ws")), items, k, similarity))
    asked = starts.select("digest").distinct()
    # Only texts with windows are split into words again, each once.
    whole = texts.join(sized_broadcast(asked, starts.count(), TEXTS_BROADCAST), "digest", "left_semi").dropDuplicates(["digest"]).select("digest", words(F.col("body")).alias("ws"))
    begun = whole.join(starts, "digest").select("digest", "n", "ws", F.explode("starts").alias("start"))
    told = begun.select("digest", "n", "start", F.slice("ws", F.col("start") + 1, F.col("n")).alias("window"))
    told = cut(told.select("digest", "n", "start", F.size("window").alias("n_words"), _shingles(F.col("window"), F.lit(k)).alias("shingles")).withColumn("fp", simhash(F.col("shingles"))))

    known = cut(items.select("item_id", "n", _shingles(F.col("ws"), F.lit(k)).alias("shingles")).withColumn("i_fp", simhash(F.col("shingles"))))
    near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")), lambda v: F.bit_count(v.bitwiseXOR(F.col("spot.value"))) <= BLOCK_ERRORS)
    index = known.withColumn("spot", F.explode(blocks(F.col("i_fp")))).select("item_id", "n", "i_fp", "spot.block", F.explode(near).alias("value"))
    keys = told.select("digest", "n", "start", "n_words", F.size("shingles").alias("size"), "fp", F.explode(blocks(F.col("fp"))).alias("spot")).select("*", "spot.block", "spot.value").drop("spot")
    difference = F.col("fp").bitwiseXOR(F.col("i_fp"))
    rows = known.count() * BLOCKS * 37
    met = keys.join(sized_broadcast(index, rows, INDEX_BROADCAST), ["n", "block", "value"]).withColumn("hamming", F.bit_count(difference))
    candidates = met.where((F.col("hamming") <= RADIUS) & (F.col("block") == first_block(difference))).select("digest", "n", "start", "n_words", "size", "item_id", "hamming")

    ours, theirs = _counted(told, "digest", "n", "start"), _counted(known, "item_id").withColumnRenamed("times", "i_times")
    shared = candidates.join(ours, ["digest", "n", "start"]).join(theirs, ["item_id", "shingle"])
    common = shared.groupBy("digest", "item_id", "start", "n", "n_words", "size", "hamming").agg(F.sum(F.least("times", "i_times")).alias("common"))
    alike = F.col("common") / (F.col("size") + F.col("n") - k + 1 - F.col("common"))
    return common.select("digest", "item_id", "start", "n_words", "hamming", alike.alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)


def leaking_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(digest, item_id, start, n_words, hamming, similarity) of the best window of each text and item; ties go to the first window."""
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), words(F.col(item_text)).alias("ws")).where("item_id is not null and size(ws) > 0").withColumn("n", F.size("ws"))
    items = cut(items.dropDuplicates(["item_id", "ws"]))
    lengths = sorted(r["k"] for r in items.groupBy(F.least("n", F.lit(shingle)).alias("k")).count().collect())  # never more than `shingle`
    if not lengths:
        return docs.sparkSession.createDataFrame([], "digest string, item_id long, start int, n_words int, hamming int, similarity double")
    found = None
    for k in lengths:
        part = _similar(docs, items.where(F.least("n", F.lit(shingle)) == k), k, text, similarity)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("first"), "n_words", "hamming"))
    merged = found.groupBy("digest", "item_id").agg(best.alias("best"))
    return merged.select("digest", "item_id", (-F.col("best.first")).alias("start"), "best.n_words", "best.hamming", "best.similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, start (word), n_words, hamming, similarity (of the best window).

    Items shorter than a shingle are looked for by shingles of their own length; a document shorter than an item is one window. Null and
    empty texts and items have no words and match nothing; items with a null id are left out; documents with a null id are found under it. Equal rows are one;
    an id with several texts has the items of each. Very long texts and items are taken whole, and windows that only repeat the one before are left out, so
    one word repeated tens of thousands of times makes one window. Other columns are not looked at, whatever their names. Empty tables give an empty result.
    """
    found = leaking_texts(docs, benchmark, text, item_text, item_key, shingle, similarity)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_digest(text).alias("digest")).join(found, "digest")
    return rows.select("doc_id", "item_id", "start", "n_words", "hamming", "similarity").distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, rows with a null id included. Null and empty texts stay. All columns as they were, whatever their names; repeated rows
    stay or go together; an empty table of documents or items changes nothing. options: of leaking_texts."""
    digest = free_name(docs, "digest")
    found = leaking_texts(docs, benchmark, text, **options).select(F.col("digest").alias(digest)).distinct()
    return docs.join(found, text_digest(text) == F.col(digest), "left_anti")
