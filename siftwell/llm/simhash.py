"""SimHash near-duplicates found by Golay fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits). Fingerprints at a small distance leave at least one segment with few
errors (pigeonhole), and the Golay code maps segments with at most two errors to a shared codeword. Keys built from segments and
codewords feed an equi-join, and each candidate is verified by its Hamming distance. Equal fingerprints are folded before
any key is made, so exact copies cost one row. near_dedup.py takes texts by the same keys and verifies them by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8, words_of
from .components import connected_components
from .golay import codeword_keys

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
CROWD = 64  # fingerprints under one key beyond which links at two bits or fewer go through shared neighbours
HUB_ROUNDS = 4  # rounds of one hub a key beyond two bits, which find most links cheaply, before all pairs that are left are listed
BLOCK = 4096  # shingles hashed at a time


def fingerprint(words: list[bytes], shingle: int, distinct: bool = False) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of the shingles; no words: 0. Fewer words than a shingle: one shingle."""
    if not words:
        return 0
    shingles: Iterator[bytes] | set[bytes] | list[bytes]
    if len(words) <= shingle:
        shingles = [b" ".join(words)] if shingle > 1 else list(words)
    elif shingle == 1:
        shingles = words
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    if distinct:
        shingles = set(shingles)
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: str | Column, shingle: int = 3, distinct: bool = False) -> Column:
    """The fingerprint of a text as a signed 64-bit column."""

    @F.arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(words_of(t.as_py()), shingle, distinct) for t in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return compute(utf8(text))


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    first, width = SEGMENTS[k]
    return (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)


def key_rows(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs. Up to two bits: an exact segment and a codeword of the next one, 33 or 34 bits of selectivity.
    Beyond: codewords of two segments, which surely meet up to five bits and mostly up to nine."""
    words = [codeword_keys(_segment(fp, k)) for k in range(3)]
    rows, keys = [], []
    for k in range(3):
        other = words[(k + 1) % 3]
        if max_bits <= 2:
            combined = np.where(other >= 0, (_segment(fp, k).astype(np.int64)[:, None] << 12 | other) << 2 | k, -1)
        else:
            mine = words[k]
            combined = np.where((mine[:, :, None] >= 0) & (other[:, None, :] >= 0), (mine[:, :, None] << 12 | other[:, None, :]) << 2 | k, -1).reshape(len(fp), -1)
        at, _ = np.nonzero(combined >= 0)
        rows.append(at)
        keys.append(combined[combined >= 0])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(points: DataFrame, max_bits: int, *more: str) -> DataFrame:
    """(key, rep, fp, and more integer columns): each distinct fingerprint under its keys."""
    names = ("rep", "fp", *more)
    schema = pa.schema([(n, pa.int64()) for n in ("key", *names)])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in whole.slice(at, 2048).columns]
                row, key = key_rows(columns[1].view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(c[row]) for c in columns]], schema=schema)

    return points.select(*names).mapInArrow(expand, ", ".join(f"{n} long" for n in ("key", *names)))


def flip_rows(fp: np.ndarray) -> np.ndarray:
    """(n, 65): a fingerprint and all its one-bit neighbours."""
    return fp[:, None] ^ np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)[None, :]


def _near(max_bits: int) -> Column:
    return F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits


def links(points: DataFrame, max_bits: int, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints at max_bits or fewer that join the same components as all such links.

    With two bits at most: under keys with up to `crowd` fingerprints, every near pair. Under the others each fingerprint meets its one-bit
    neighbourhood, and two fingerprints are within two bits exactly if they share a neighbour, so links to the least member of each shared
    neighbour lose nothing and grow in proportion. With more bits: spanning_links.
    """
    if max_bits > 2:
        return spanning_links(points, max_bits)
    keys = keyed(points, max_bits)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = cut(keys.join(sizes, "key"))  # fingerprints that are alone under a key end here
    small = full.where(F.col("n") <= crowd).select("key", "rep", "fp")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & _near(max_bits))
    found = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    crowded = full.where(F.col("n") > crowd)
    return found.unionByName(_through_neighbours(crowded.select("rep", "fp").distinct())).distinct()


def _meeting(points: DataFrame, max_bits: int) -> DataFrame:
    """(key, rep, fp) under keys that several points share."""
    keys = keyed(points, max_bits)
    return keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key")


def spanning_links(points: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links that join the same components as all pairs which meet under a key at max_bits or fewer.

    In each round every key has one hub, and each member takes one near hub of another component. In the end every near pair of two components that
    meets under a key is listed; pairs inside a component can't change it.
    """
    full = cut(_meeting(points, max_bits))
    members = full.select("*", F.col("rep").alias("c"))
    found = None
    for k in range(HUB_ROUNDS):
        hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(k)), "rep", "fp", "c")).alias("hub"))
        offers = members.join(hubs, "key").where((F.col("c") != F.col("hub.c")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= max_bits))
        taken = offers.groupBy("rep").agg(F.min("hub").alias("hub"))
        new = cut(taken.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct())
        found = new if found is None else found.unionByName(new)
        if not new.count():
            break
        parts = cut(connected_components(found))
        members = full.join(parts, full["rep"] == parts["node"], "left").select("key", "rep", "fp", F.coalesce("component", "rep").alias("c"))
    ends = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    left = members.join(ends, "key")
    x, y = left.alias("x"), left.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")) & _near(max_bits))
    return found.unionByName(rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def _through_neighbours(points: DataFrame) -> DataFrame:
    schema = pa.schema([("near", pa.int64()), ("rep", pa.int64())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                rep, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(flip_rows(fp.view(np.uint64)).view(np.int64).ravel()), pa.array(np.repeat(rep, 65))], schema=schema)

    near = points.mapInArrow(expand, "near long, rep long")
    least = near.groupBy("near").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return near.join(least, "near").where("rep != a").select("a", F.col("rep").alias("b")).distinct()


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, fp (signed fingerprint), component_id (smallest doc_id that can be reached).

    Null and empty texts have fingerprint zero and are linked like any other. A row with a null id gets its fingerprint's component and
    never names one; a component of null ids alone has a null id. Repeated rows are returned each. Very long texts are hashed whole, a block of
    shingles at a time. Other columns are not looked at, whatever their names. An empty table gives an empty result.
    """
    prints = cut(docs.select(F.col(key).cast("long").alias("doc_id"), fingerprint_column(text, shingle).alias("fp")))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = points.where("rep is not null")
    parts = connected_components(links(named, max_bits))
    labels = points.join(parts, points["rep"] == parts["node"], "left").select(F.col("fp").alias("label_fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(labels, F.col("fp") == F.col("label_fp")).select("doc_id", "fp", "component_id")
