"""An inverted file of vectors with product-quantised residuals, for approximate search.

Centroids and codebooks are fitted to a bounded sample; every vector is stored, in the part of its nearest centroid, once as a short code and once as it is. A search visits the parts of
the centroids nearest to each query, estimates similarities from the codes alone, and computes them exactly for the best candidates. Parts that no query visits aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..sources import shared
from ..sources.snapshots import Store, Transaction
from .search import Best, top, vector_arm

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 128 << 20  # bounds of the sample that is fitted on the driver
MOST_CELLS, CODES = 4_096, 256
SUB_WIDTH = 4  # values of a vector that one byte of its code stands for
CELL_ROWS = 50_000  # rows of a cell that one task writes; larger cells are dealt to several
TILE_ROWS, TILE_BYTES = 50_000, 32 << 20  # of cells that are scanned together, and bytes of their vectors or of a block of queries
FOUND_ROWS = 1_500_000  # that a tile may find for a block of queries
DEPTH = 40  # candidates that are compared exactly, times the limit
TUNED_QUERIES, TUNED_LIMIT, TARGET = 200, 10, 0.95  # stored vectors that are searched exactly to choose the number of probes, their neighbours, the share of these that must lie in the cells


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of k clusters; a cluster that runs empty takes the row furthest from its centre."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        for empty, row in zip(np.flatnonzero(n == 0), np.argsort(-far, kind="stable"), strict=False):
            sums[empty], n[empty] = x[row], 1
        centres = sums / n[:, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance to it."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = (part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1)[None, :]
        near[at : at + 4096] = d.argmin(1)
        far[at : at + 4096] = d.min(1)
    return near, far


class Model:
    """Centroids of unit vectors, and for each few values of a residual a codebook."""

    def __init__(self, centroids: np.ndarray, books: list[np.ndarray]) -> None:
        self.centroids, self.books = centroids, books
        self.ends = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        centroids = kmeans(x, min(cells, len(x)), rng)
        rest = x - centroids[nearest_centre(x, centroids)[0]]
        books = [kmeans(rest[:, a : a + SUB_WIDTH], min(CODES, max(1, len(x) // 4)), rng, 8) for a in range(0, x.shape[1], SUB_WIDTH)]
        return cls(centroids, books)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector and the code of what is left of it there."""
        cell = nearest_centre(x, self.centroids)[0]
        rest = x - self.centroids[cell]
        codes = [nearest_centre(rest[:, a:b], book)[0].astype(np.uint8) for a, b, book in zip(self.ends, self.ends[1:], self.books, strict=False)]
        return cell, np.stack(codes, 1)

    def estimates(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """(queries, rows) similarities of unit queries to the coded rows of a cell."""
        return q @ self.decode(cell, codes).T

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for: their products with a query are the sums of its products with the codebooks' centres."""
        return self.centroids[cell] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)


def _unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors, and those vectors at length one."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(lists.offsets.to_numpy()) == width))
    x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    length = np.linalg.norm(x, axis=1)
    fine = np.isfinite(length) & (length > 0)
    return rows[fine], x[fine] / length[fine, None]


class VectorIndex:
    """An index under a folder that the driver and all executors reach. All its vectors have one width."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def build(self, vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
        """Writes vectors (document_id, chunk_id, embedding) anew. The width is that of most of the sample; vectors of another width or without length can match nothing and aren't stored. The
        sample is chosen by the hash of the id; about the square root of the number of vectors is the number of cells."""
        some = vectors.where(F.size("embedding") > 0)
        widths = some.orderBy(F.xxhash64("chunk_id")).limit(sample_rows).groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "w").first()
        if widths is None:
            raise ValueError("no vectors")
        width = widths["w"]
        rows = max(64, min(sample_rows, SAMPLE_BYTES // (8 * width)))
        told = some.where(F.size("embedding") == width).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(rows).select(F.col("embedding").cast("array<double>")).toArrow()
        sample = _unit_rows(told.column(0), width)[1]
        if not len(sample):
            raise ValueError("no vectors that have a length")
        n = some.count()
        model = Model.fit(sample, cells or max(1, min(MOST_CELLS, round(n**0.5), len(sample) // 8)))
        t = self.store.begin()
        centroids = [(k, c.tolist()) for k, c in enumerate(model.centroids)]
        books = [(j, k, v.tolist()) for j, book in enumerate(model.books) for k, v in enumerate(book)]
        t.replace("centroids", self.spark.createDataFrame(centroids, "cell int, centroid array<double>").coalesce(1))
        t.replace("books", self.spark.createDataFrame(books, "sub int, code int, centre array<double>").coalesce(1))
        self._put(t, model, vectors, True)
        t.commit()
        self.tune()

    def tune(self, target: float = TARGET) -> int:
        """Chooses how many cells a search visits by default, and stores it: the fewest that hold target of the exact neighbours of some stored vectors, which are searched for in all vectors."""
        t = self.store.begin()
        model, rows = self._model(t), t.read("vectors")
        some = shared.cut(rows.orderBy(F.xxhash64("chunk_id", F.lit("tune")), "chunk_id").limit(TUNED_QUERIES).select(F.col("chunk_id").alias("query_id"), "embedding"))
        found = vector_arm(rows.withColumn("document_id", F.lit(0)), some, TUNED_LIMIT + 1).where("chunk_id != query_id").select("query_id", "chunk_id")
        met = found.join(rows.select("chunk_id", "cell"), "chunk_id").join(some, "query_id").select("cell", F.col("embedding").cast("array<double>").alias("v")).toArrow()  # TUNED_QUERIES x TUNED_LIMIT
        kept, units = _unit_rows(met.column("v"), model.centroids.shape[1])
        cell = met.column("cell").to_numpy()[kept]
        near = units @ model.centroids.T
        places = np.sort((near > near[np.arange(len(cell)), cell][:, None]).sum(1)) if len(cell) else np.zeros(1, int)
        probes = int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1
        t.replace("probes", self.spark.createDataFrame([(probes,)], "probes int")).commit()
        return probes

    def add(self, vectors: DataFrame) -> None:
        """Stores more vectors under the centroids there are."""
        t = self.store.begin()
        self._put(t, self._model(t), vectors, False)
        t.commit()

    def _put(self, t: Transaction, model: Model, vectors: DataFrame, anew: bool) -> None:
        width = model.centroids.shape[1]
        schema = pa.schema([("document_id", pa.int64()), ("chunk_id", pa.int64()), ("cell", pa.int32()), ("code", pa.binary()), ("embedding", pa.list_(pa.float64()))])

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, x = _unit_rows(batch.column(2), width)
                if len(rows):
                    cell, codes = model.encode(x)
                    kept = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(2).take(kept)], schema=schema)

        plain = vectors.select(F.col("document_id").cast("long"), F.col("chunk_id").cast("long"), F.col("embedding").cast("array<double>"))
        rows = shared.cut(plain.mapInArrow(coded, "document_id long, chunk_id long, cell int, code binary, embedding array<double>"))
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        # A cell of many rows is written by several tasks.
        dealt = rows.join(F.broadcast(sizes), "cell").withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / CELL_ROWS))).repartition("cell", "salt").sortWithinPartitions("cell", "chunk_id")
        put = t.replace if anew else t.append
        put("codes", dealt.select("document_id", "chunk_id", "cell", "code"), F.col("cell"), dealt=True)
        put("vectors", dealt.select("document_id", "chunk_id", "cell", "embedding"), F.col("cell"), dealt=True)
        put("sizes", sizes)

    def _model(self, t: Transaction) -> Model:
        centroids = np.array([r["centroid"] for r in t.read("centroids").orderBy("cell").collect()])  # MOST_CELLS at most
        books: dict[int, list] = {}
        for r in t.read("books").orderBy("sub", "code").collect():
            books.setdefault(r["sub"], []).append(r["centre"])
        return Model(centroids, [np.array(b) for _, b in sorted(books.items())])

    def _tiles(self, t: Transaction, most: int) -> list[tuple[int, int, int]]:
        """(cell, first, slices): the tiles, of most rows about, that hold a cell's rows. Small cells share one, large ones are sliced by the hash of the id."""
        out, tile, held = [], 0, 0
        for r in t.read("sizes").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect():  # MOST_CELLS at most
            slices = -(-r["n"] // most)
            if held and held + r["n"] > most:
                tile, held = tile + 1, 0
            out.append((r["cell"], tile, slices))
            tile, held = (tile + slices, 0) if slices > 1 else (tile, held + r["n"])
        return out

    def search(self, queries: DataFrame, limit: int, probes: int | None = None, depth: int | None = None) -> DataFrame:
        """query_id, document_id, chunk_id, score, rank: the limit best rows of each query (query_id, embedding) among the probes cells nearest to it, by default as many as tune chose. Scores
        are exact cosines; what may be missing is a row of a cell that wasn't visited, or one that its code puts behind depth others. Where depth is no less than all rows, codes can't put any row
        behind and the visited cells' vectors are compared at once.

        Cells are scanned in tiles, each with the queries that visit one of its cells, in blocks; a tile hands on its best rows of each query. Tiles and blocks are of bounded size, so a task holds no more
        whatever the number of rows and queries, and pairs of queries and rows are never written."""
        t = self.store.begin()
        model, depth = self._model(t), depth or DEPTH * limit
        cells, width = len(model.centroids), model.centroids.shape[1]
        probes = min(probes or t.read("probes").first()["probes"], cells)
        whole = depth >= (t.read("sizes").agg(F.sum("n").alias("n")).first()["n"] or 0)
        most = max(1, min(TILE_ROWS, TILE_BYTES // (8 * width)))
        keep = limit if whole else depth
        blocks = max(1, -(-queries.count() // max(1, min(FOUND_ROWS // min(keep, most), TILE_BYTES // (8 * width)))))
        tiles = self._tiles(t, most)
        first, slices = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for cell, at, n in tiles:
            first[cell], slices[cell] = at, n
        schema = pa.schema([("query_id", pa.int64()), ("tile", pa.int32()), ("visited", pa.list_(pa.int32())), ("unit", pa.list_(pa.float64()))])

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, q = _unit_rows(batch.column(1), width)
                for at in range(0, len(rows), 256):
                    some = q[at : at + 256]
                    near = np.sort(np.argsort(-(some @ model.centroids.T), axis=1, kind="stable")[:, :probes], axis=1)
                    row, cell = np.repeat(np.arange(len(some)), probes), near.ravel()
                    n = slices[cell]
                    row, cell, nth = np.repeat(row, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    if not len(row):
                        continue
                    tile = first[cell] + nth
                    order = np.lexsort((cell, tile, row))
                    row, cell, tile = row[order], cell[order], tile[order]
                    begin = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(tile) != 0)])
                    units = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1) * width, pa.int32()), pa.array(some[row[begin]].ravel()))
                    visited = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(row)], pa.int32()), pa.array(cell, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at : at + 256][row[begin]])), pa.array(tile[begin], pa.int32()), visited, units], schema=schema)

        plain = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
        asked = shared.cut(plain.mapInArrow(visits, "query_id long, tile int, visited array<int>, unit array<double>"))
        wanted = sorted(r["cell"] for r in asked.select(F.explode("visited").alias("cell")).distinct().collect())  # MOST_CELLS at most
        where = F.broadcast(self.spark.createDataFrame(tiles, "cell int, first int, slices int"))
        spot = (F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("slices"))).cast("int").alias("tile")
        block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        rows = t.read("vectors" if whole else "codes", wanted).join(where, "cell").select("document_id", "chunk_id", "cell", F.col("embedding" if whole else "code").alias("body"), spot, block)
        ask = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], f) for f in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())], names=["query_id", "document_id", "chunk_id", "score", "cell"])
            left = left.sort_by([("cell", "ascending"), ("chunk_id", "ascending")]).combine_chunks()
            right = right.combine_chunks()
            chunk, doc, cell, query = (t_.column(c).to_numpy() for t_, c in ((left, "chunk_id"), (left, "document_id"), (left, "cell"), (right, "query_id")))
            visited = pa.concat_arrays(right.column("visited").chunks)
            units = pa.concat_arrays(right.column("unit").chunks).flatten().to_numpy().reshape(-1, width)
            asks, by = np.repeat(np.arange(len(query)), np.diff(visited.offsets.to_numpy())), visited.flatten().to_numpy()
            asks, by = asks[order := np.argsort(by, kind="stable")], by[order]
            body, found = pa.concat_arrays(left.column("body").chunks), Best(len(query), keep)
            for c in np.unique(cell).tolist():
                mine = asks[np.searchsorted(by, c) : np.searchsorted(by, c, "right")]
                a, b = np.searchsorted(cell, c), np.searchsorted(cell, c, "right")
                for at in range(a if len(mine) else b, b, 4096):
                    part = slice(at, min(at + 4096, b))
                    if whole:
                        x = _unit_rows(body[part], width)[1]
                    else:
                        x = model.decode(c, np.frombuffer(b"".join(body[part].to_pylist()), np.uint8).reshape(part.stop - at, -1))
                    found.offer(mine, units[mine], x, chunk[part], np.arange(part.start, part.stop))
            q, score, chunk_, at = found.settle()
            return pa.table([query[q], doc[at], chunk_, score, cell[at]], names=["query_id", "document_id", "chunk_id", "score", "cell"])

        key = ["tile", "block"]
        met = rows.groupBy(*key).cogroup(ask.groupBy(*key)).applyInArrow(best, "query_id long, document_id long, chunk_id long, score double, cell int")
        order = [F.round("score", 9).desc(), F.col("chunk_id")]
        if whole:
            return top(met.drop("cell"), limit, order)
        candidates = top(met, depth, [F.col("score").desc(), F.col("chunk_id")]).drop("rank", "score")
        exact = candidates.join(t.read("vectors", wanted).drop("document_id"), ["cell", "chunk_id"]).join(plain.withColumnRenamed("embedding", "asked"), "query_id")
        scored = exact.select("query_id", "document_id", "chunk_id", vec.cosine_similarity(F.col("embedding"), F.col("asked")).alias("score"))
        return top(scored, limit, order)
