"""Near-duplicate documents: Golay keys propose pairs, shingle sets decide, and one document of each group stays.

A link is a pair of texts whose fingerprints over the distinct words meet under a Golay key and differ in at most max_bits, whose second fingerprints, by other hashes, differ in at most
MORE_BITS, and whose sets of five-word shingles have a cosine of at least the similarity. That holds under every key, and no link is lost to the size of a group:

* Under a key with up to CROWD texts all pairs within these bits are listed and verified at once, unless they are more than DENSE for each text: such a key counts as crowded.
* Under a crowded key each text is first compared with the key's hub, the text that shares the most keys with others (the original, if the crowd
  is one text with its edited copies). Of what the hubs leave apart, all pairs within the bits are listed under keys with up to LISTED texts, again unless they are more than DENSE for each text.
* What is left goes through an exact set-similarity join: shingles are ordered from rare to common, and two sets can only reach the similarity if
  they share one of the first few (prefix filter, with the prefix as short as the other set's size allows), with enough shingles after the first that they
  share (positional filter, by both sizes). An edited copy that is unlike the hub has so many shingles of its own that these alone are its prefix, and shingles
  of one text only are never written, so it meets nothing but its own kind. Texts in this join need not share a key to be linked.

Candidates are cut down by set sizes and by a 256-cell count sketch, both upper bounds of the overlap, before any shingles are fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, sized_broadcast, utf8, words_of
from .components import connected_components
from .simhash import SEED, keyed, majority

CROWD = 64  # texts under one key up to which all pairs are listed at once
LISTED = 4096  # texts under one key up to which all pairs are listed that the hubs leave apart
MORE_BITS = 16  # that the second fingerprints may differ in: a text with some bits to its copy has as many again but for chance, unrelated texts have far more in one of the two
CELL = 1 << 20  # comparisons at a time
DENSE = 4  # near pairs for each text of a key up to which they are listed: a list grows with the texts under the key, not with their square
SHARED = 200_000  # shingles of several texts that are broadcast
CELLS = 256  # of the count sketch
STEP = 1.05  # ratio of the sizes in one class of set sizes
SMALL_ENDS = 1_000_000  # ids that are broadcast, so that the texts needn't be dealt out
HOT_KEYS = 500_000  # crowded keys that are broadcast


def print_and_digest(text: str | Column) -> Column:
    """struct<fp long, more long, digest binary>: the fingerprint over the distinct words, a second one by other hashes, and a 128-bit digest of all words in order."""

    @F.arrow_udf("struct<fp: long, more: long, digest: binary>")
    def compute(texts: pa.Array) -> pa.Array:
        values, more, digests = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64), []
        for k, t in enumerate(texts):  # one text's words at a time
            words = words_of(t.as_py())
            distinct = set(words)
            values[k], more[k] = (majority(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))) for seed in (SEED, SEED + 1))
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
        return pa.StructArray.from_arrays([pa.array(values.view(np.int64)), pa.array(more.view(np.int64)), pa.array(digests, pa.binary())], ["fp", "more", "digest"])

    return compute(utf8(text))


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle are one shingle."""
    if not words:
        return np.empty(0, np.int64)
    parts = {b" ".join(words)} if len(words) <= shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts)).view(np.int64))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two sets given as arrays of distinct values; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / float(np.sqrt(len(a) * len(b)))


def cells(bag: np.ndarray) -> np.ndarray:
    """How many shingles fall into each cell, up to 255: the sum of the smaller counts of two sets is at least their overlap."""
    return np.minimum(np.bincount(bag & (CELLS - 1), minlength=CELLS), 255).astype(np.uint8)


def bags(docs: DataFrame, ends: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """(rep, n, cells, bag) of the documents in ends (rep): size, sketch and sorted hashes of the shingle set."""

    @F.arrow_udf("struct<n: int, cells: binary, bag: binary>")
    def compute(texts: pa.Array) -> pa.Array:
        found = [shingle_set(words_of(t.as_py()), shingle) for t in texts]
        columns = [pa.array([len(b) for b in found], pa.int32()), pa.array([cells(b).tobytes() for b in found], pa.binary()), pa.array([b.tobytes() for b in found], pa.binary())]
        return pa.StructArray.from_arrays(columns, ["n", "cells", "bag"])

    asked = sized_broadcast(ends.select("rep"), ends.count(), SMALL_ENDS)
    rows = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("body")).join(asked, "rep", "left_semi").dropDuplicates(["rep"])
    return rows.select("rep", compute(utf8("body")).alias("told")).select("rep", "told.n", "told.cells", "told.bag")


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) with a cosine of at least similarity. held: bags of all their documents."""

    @F.arrow_udf("boolean")
    def possible(n: pa.Array, m: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        need = similarity * np.sqrt(n.to_numpy().astype(float) * m.to_numpy()) - 1e-9
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), CELLS) for c in (a, b))
        bound = np.minimum(np.minimum(x, y).sum(axis=1, dtype=np.int64), np.minimum(n.to_numpy(), m.to_numpy()))
        return pa.array((bound >= need) | (x == 255).any(axis=1) | (y == 255).any(axis=1))

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([cosine(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)) >= similarity - 1e-12 for x, y in zip(a, b, strict=True)], pa.bool_())

    def side(name: str, *columns: str) -> DataFrame:
        return held.select(F.col("rep").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    light = pairs.join(side("a", "n", "cells"), "a").join(side("b", "n", "cells"), "b")
    left = cut(light.where(possible("n_a", "n_b", "cells_a", "cells_b")).select("a", "b"))
    ends = cut(left.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    held = held.join(sized_broadcast(ends, ends.count(), SMALL_ENDS), "rep", "left_semi")
    return left.join(side("a", "bag"), "a").join(side("b", "bag"), "b").where(alike("bag_a", "bag_b")).select("a", "b")


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _bits(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def listed_pairs(members: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): all pairs of different components within max_bits that meet under a key; and (key): the keys with more than DENSE of them for each text, whose pairs are not among these.
    members: (key, rep, fp, more, c), not more than LISTED for a key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near_places(fp: np.ndarray, more: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of keys with n texts each, a row a key: which are dense, and key, place and place of the near pairs of the others."""
        keys, n = fp.shape
        height, count, found = max(1, CELL // (keys * n)), np.zeros(keys, np.int64), []
        for lo in range(0, n, height):
            x, y = (slice(None), slice(lo, lo + height), None), (slice(None), None, slice(lo, None))
            near = (np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= max_bits) & (c[x] != c[y])
            near &= np.bitwise_count((more[x] ^ more[y]).view(np.uint64)) <= MORE_BITS
            k, i, j = np.nonzero(np.triu(near, 1))
            count += np.bincount(k, minlength=keys)
            left = count[k] <= DENSE * n
            found.append((k[left], i[left] + lo, j[left] + lo))
            if (count > DENSE * n).all():
                break
        k, i, j = (np.concatenate(f) for f in zip(*found, strict=True))
        left = count[k] <= DENSE * n
        return count > DENSE * n, k[left], i[left], j[left]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for n in np.unique(sizes).tolist():
                same, step = np.flatnonzero(sizes == n), max(1, CELL // (n * n))
                for at in range(0, len(same), step):
                    part = batch.take(pa.array(same[at : at + step]))
                    rep, fp, more, c = (part.column(k).flatten().to_numpy().reshape(-1, n) for k in (2, 3, 4, 5))
                    dense, k, i, j = near_places(fp, more, c)
                    a, b = rep[k, i], rep[k, j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)
                    if dense.any():
                        yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(dense)), pa.nulls(int(dense.sum()), pa.int64())], schema=schema)

    lists = members.groupBy("key").agg(F.collect_list(F.struct("rep", "fp", "more", "c")).alias("m"))
    lists = lists.select("key", F.size("m").alias("n"), F.col("m.rep").alias("rep"), F.col("m.fp").alias("fp"), F.col("m.more").alias("more"), F.col("m.c").alias("c"))
    told = cut(lists.mapInArrow(expand, "a long, b long").distinct())  # a key stands in a, without b
    return told.where("b is not null"), told.where("b is null").select(F.col("a").alias("key"))


def _with_components(rows: DataFrame, parts: DataFrame | None, name: str = "c", rep: str = "rep") -> DataFrame:
    if parts is None:
        return rows.withColumn(name, F.col(rep))
    told = parts.select(F.col("node").alias("_node"), F.col("component").alias("_part"))
    return rows.join(told, F.col(rep) == F.col("_node"), "left").withColumn(name, F.coalesce("_part", rep)).drop("_node", "_part")


def _near(x: str, y: str, max_bits: int) -> Column:
    """Whether both fingerprints of two rows are near. x, y: what stands before their columns' names."""
    return (_bits(f"{x}fp", f"{y}fp") <= max_bits) & (_bits(f"{x}more", f"{y}more") <= MORE_BITS)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep"))


def crowded_links(crowd: DataFrame, near: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_bits: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) of texts to the hubs of their crowded keys; the pairs that are left to verify, those of near among them; and the bags of all their documents.

    crowd: (key, rep, fp, more, n). fetch: gives the bags of documents (rep); only those of texts that meet a near one are asked for, as a crowded key also holds many that don't.
    """
    degree = crowd.groupBy("rep").agg(F.sum("n").alias("degree"))
    rows = cut(crowd.select("key", "rep", "fp", "more").join(degree, "rep"))
    # A maximum is combined before the shuffle, so hot keys cost little.
    best = rows.groupBy("key").agg(F.max(F.struct("degree", "rep", "fp", "more")).alias("hub"))
    best = cut(best.select("key", F.col("hub.degree").alias("h_degree"), F.col("hub.rep").alias("hub"), F.col("hub.fp").alias("h_fp"), F.col("hub.more").alias("h_more")))
    asked = rows.join(best, "key").where((F.col("rep") != F.col("hub")) & _near("", "h_", max_bits)).groupBy("rep").agg(F.max(F.struct("h_degree", "hub")).alias("h"))
    tried = cut(asked.select(*_pairs("rep", "h.hub")).distinct())
    held = fetch(_ends(tried.unionByName(near)))
    found = cut(verified(tried, held, similarity))
    parts = cut(connected_components(found))
    members = cut(_with_components(rows, parts))
    left = cut(members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi").select("key", "n"))
    rest, dense = listed_pairs(members.join(left.where(F.col("n") <= LISTED).select("key"), "key"), max_bits)
    large = left.where(F.col("n") > LISTED).select("key").unionByName(dense)
    texts = cut(members.join(large, "key").groupBy("rep").agg(F.first("fp").alias("fp"), F.first("more").alias("more"), F.first("c").alias("c")))
    asked = texts.select("rep").unionByName(_ends(rest)).distinct()
    held = held.unionByName(fetch(asked.join(held.select("rep"), "rep", "left_anti")))
    if not texts.isEmpty():
        rest = rest.unionByName(prefix_pairs(texts, held, max_bits, similarity))
    open_near = _with_components(_with_components(near, parts, "c_a", "a"), parts, "c_b", "b").where("c_a != c_b").select("a", "b")
    return found, open_near.unionByName(rest).distinct().join(tried, ["a", "b"], "left_anti"), held


def prefix_pairs(texts: DataFrame, held: DataFrame, max_bits: int, similarity: float) -> DataFrame:
    """(a, b): the pairs of two components within max_bits that share a shingle of both prefixes with enough shingles after it. No pair of that similarity is missed.

    texts: (rep, fp, more, c). Of the texts that hold a shingle, those of its main component only answer and the others ask and answer, so two of one component seldom meet.
    """
    weights = texts.groupBy("c").agg(F.count(F.lit(1)).alias("weight"))
    texts = cut(texts.join(weights, "c"))
    texts = cut(held.select("rep", F.col("n").alias("size"), "bag").join(sized_broadcast(texts, texts.count(), SMALL_ENDS), "rep"))

    @F.arrow_udf("array<long>")
    def shingles(found: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b.as_py(), np.int64) for b in found], pa.list_(pa.int64()))

    each = texts.select("rep", "c", "weight", F.explode(shingles("bag")).alias("s"))
    # The main component of a shingle is the largest of those that hold it.
    some = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("weight", "c")).alias("main"), F.min(F.struct("weight", "c")).alias("least")).where("n > 1")
    shared = cut(some.select("s", "n", F.col("main.c").alias("main"), (F.col("main") != F.col("least")).alias("open")))
    told = each.select("rep", "s").join(sized_broadcast(shared, shared.count(), SHARED), "s").groupBy("rep").agg(F.collect_list(F.struct("s", "n", "main", "open")).alias("m"))
    told = texts.drop("bag").join(told, "rep").select("rep", "fp", "more", "c", "size", F.col("m.s").alias("s"), F.col("m.n").alias("n"), F.col("m.main").alias("main"), F.col("m.open").alias("open"))

    names = ("rep", "fp", "more", "c", "size", "s", "place", "class")
    schema = pa.schema([*((n, pa.int64()) for n in names), ("asks", pa.bool_())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(("rep", "fp", "more", "c", "size", "s", "n", "main", "open"))}
            for i in range(batch.num_rows):
                size, c = column["size"][i].as_py(), column["c"][i].as_py()
                s, n, main, open_ = (column[k][i].values.to_numpy(zero_copy_only=False) for k in ("s", "n", "main", "open"))
                order = np.lexsort((s, n))
                for asks in (False, True):
                    places, classes = (asking if asks else answering)(size, similarity)
                    at = places - (size - len(order))  # the text's own shingles come first and meet nothing
                    places, classes, at = places[at >= 0], classes[at >= 0], order[at[at >= 0]]
                    meets = open_[at] & (main[at] != c) if asks else open_[at]
                    ids = [pa.array(np.full(int(meets.sum()), column[k][i].as_py(), np.int64)) for k in ("rep", "fp", "more", "c", "size")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(s[at][meets]), pa.array(places[meets]), pa.array(classes[meets]), pa.array(np.full(int(meets.sum()), asks))], schema=schema)

    spread = cut(told.mapInArrow(expand, "rep long, fp long, more long, c long, size long, s long, place long, class long, asks boolean"))
    x, y = spread.where("asks").alias("x"), spread.where("not asks").alias("y")
    same = (F.col("x.s") == F.col("y.s")) & (F.col("x.class") == F.col("y.class"))
    after = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    enough = after >= F.lit(similarity) * F.sqrt(F.col("x.size") * F.col("y.size")) - 1e-9
    return x.join(y, same & (F.col("x.c") != F.col("y.c")) & enough & _near("x.", "y.", max_bits)).select(*_pairs("x.rep", "y.rep")).distinct()


def size_class(n: int) -> int:
    return int(np.log(n) / np.log(STEP) + 1e-9)


def answering(n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the prefix of a set of n shingles that holds whatever the other set's size, with the class of the set's own size."""
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    prefix = np.arange(n - int(np.ceil(similarity**2 * n - 1e-9)) + 1)
    return prefix, np.full(len(prefix), size_class(n), np.int64)


def asking(n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each class of sizes that the other set can have, the places of the prefix for the smallest size in it, with that class."""
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    out, classes = [], []
    for k in range(size_class(max(1, int(similarity**2 * n))), size_class(int(n / similarity**2) + 1) + 1):
        least = max(STEP**k - 1, similarity**2 * n)
        prefix = np.arange(max(0, n - int(np.ceil(similarity * np.sqrt(n * least) - 1e-9)) + 1))
        out.append(prefix)
        classes.append(np.full(len(prefix), k, np.int64))
    return np.concatenate(out), np.concatenate(classes)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8, max_bits: int = 16) -> DataFrame:
    """docs with one document left of each group of near-duplicates, the one with the smallest id. All columns as they were, whatever their names.

    Texts of the same words (A-Z lower-cased) in the same order are one text. Null and empty texts and texts without words are all kept, and so are rows with a
    null id and rows whose id stands at several different texts, as such an id names no single document. Repeated rows of a document stay or go together. Very long texts are
    worked on one at a time, whole. An empty table gives an empty result.
    """
    told = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), print_and_digest(text).alias("told")).select("doc_id", "told.fp", "told.more", "told.digest")
    one_text = told.groupBy("doc_id").agg(F.min("fp").alias("fp"), F.min("more").alias("more"), F.min("digest").alias("digest"), F.max("digest").alias("other")).where("digest = other and fp != 0")
    prints = cut(one_text.select("doc_id", "fp", "more", "digest"))
    points = cut(prints.groupBy("fp", "digest").agg(F.min("doc_id").alias("rep"), F.min("more").alias("more"), F.count(F.lit(1)).alias("copies")))
    copied = points.where("copies > 1").select("fp", "digest", "rep")
    twins = prints.join(copied, ["fp", "digest"]).where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    keys = keyed(points, max_bits, "more")
    # A key's number of texts is combined before the shuffle, so a key with a third of all texts costs no more than others.
    sizes = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = keys.join(sizes.where(F.col("n") <= CROWD).select("key"), "key").withColumn("c", F.col("rep"))
    near, dense = listed_pairs(few, max_bits)
    hot = cut(sizes.where(F.col("n") > CROWD).unionByName(sizes.join(dense, "key")))
    crowd = cut(keys.join(sized_broadcast(hot, hot.count(), HOT_KEYS), "key"))

    def fetch(ends: DataFrame) -> DataFrame:
        return cut(bags(docs, cut(ends.distinct()), text, key, shingle))

    links = twins
    if crowd.isEmpty():
        held = fetch(_ends(near))
    else:
        known, near, held = crowded_links(crowd, near, fetch, max_bits, similarity)
        near, links = cut(near), links.unionByName(known)
    parts = connected_components(links.unionByName(verified(near, held, similarity)))
    gone = free_name(docs, "gone")
    losers = parts.where("node != component").select(F.col("node").alias(gone)).distinct()
    return docs.join(losers.join(prints.select(F.col("doc_id").alias(gone)), gone, "left_semi"), docs[key].cast("long") == F.col(gone), "left_anti")
