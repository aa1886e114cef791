"""Tags: canonical names, merges, attachments."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources import shared

MERGE_THRESHOLD = 0.85
TILE_BYTES = 64 << 20  # bytes of vectors that one task holds as a matrix of either side, about
TILE = 16_384  # and rows at most
BLOCK = 2_048  # names of a tenant that one round settles
TERMS_BROADCAST = 1_000_000  # terms with their counts that are broadcast
GROUP = ["tenant_id", "width"]


def nearest(names: DataFrame, tags: DataFrame, threshold: float = MERGE_THRESHOLD, earlier: bool = False) -> DataFrame:
    """(name_id, tag_id, similarity): the tag of the same tenant with the greatest cosine similarity of threshold or more, the smaller id on ties.
    names: (tenant_id, name_id, embedding); tags: (tenant_id, tag_id, embedding), with whole numbers as ids. Vectors without length match nothing, and only vectors of one width meet.
    With earlier, only tags whose id is smaller than the name's count.

    A tenant's names and tags are dealt to the rows and columns of a grid with about a tile of either to a cell; a cell multiplies two matrices and hands on one tag
    for each of its names. A tenant of any size is so many cells, and a name crosses the shuffle once for every tile of tags.
    """
    left, right = _sized(names, "name_id"), _sized(tags, "tag_id")
    grid = _tiles(left, "n_rows").join(_tiles(right, "n_columns"), GROUP)
    x = _dealt(left.join(grid, GROUP), "tile_row", "n_rows", "tile_column", "n_columns")
    y = _dealt(right.join(grid, GROUP), "tile_column", "n_columns", "tile_row", "n_rows")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        (name, a), (tag, b) = _units(left), _units(right)
        found = []
        for at in range(0, len(name) if len(tag) else 0, 1024):
            sims = np.clip(a[at : at + 1024] @ b.T, -1, 1)
            if earlier:
                sims[tag[None, :] >= name[at : at + 1024, None]] = -2
            first = np.round(sims, 9).argmax(axis=1)  # the first of equal ones has the smallest id
            top = sims[np.arange(len(sims)), first]
            near = np.flatnonzero(top >= threshold)
            found.append((name[at + near], tag[first[near]], top[near]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(columns, names=["name_id", "tag_id", "similarity"])

    cell = ["tenant", "size", "tile_row", "tile_column"]  # aliases, as names and tags may come from one table
    met = x.groupBy(*cell).cogroup(y.groupBy(*cell)).applyInArrow(best, "name_id long, tag_id long, similarity double")
    most = met.groupBy("name_id").agg(F.max_by(F.struct("tag_id", "similarity"), F.struct(F.round("similarity", 9), -F.col("tag_id"))).alias("b"))
    return most.select("name_id", "b.tag_id", "b.similarity")


def _sized(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & (F.size("embedding") > 0)).select("tenant_id", F.size("embedding").alias("width"), F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _tiles(rows: DataFrame, name: str) -> DataFrame:
    """How many tiles a group's vectors make, by their bytes."""
    most = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (8 * F.col("width")))))
    return rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).select(*GROUP, F.ceil(F.col("n") / most).cast("int").alias(name))


def _dealt(rows: DataFrame, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
    spot = F.pmod(F.xxhash64("id", "embedding"), F.col(own_count)).cast("int")
    return rows.select(F.col("tenant_id").alias("tenant"), F.col("width").alias("size"), "id", "embedding", spot.alias(own), F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)).alias(other))


def _units(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors at length one, without those that have no length."""
    if not rows.num_rows:
        return np.empty(0, np.int64), np.empty((0, 0))
    rows = rows.sort_by("id").combine_chunks()
    ids = rows.column("id").to_numpy()
    flat = rows.column("embedding").combine_chunks()
    matrix = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    length = np.linalg.norm(matrix, axis=1)
    fine = length > 0
    return ids[fine], matrix[fine] / length[fine, None]


def _settle(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Of a block of names in order: those that become tags, each unless an earlier one of the block is near it."""

    def settled(block: pa.Table) -> pa.Table:
        ids, units = _units(block)
        open_, new = np.ones(len(ids), bool), []
        for k in range(len(ids)):
            if open_[k]:
                new.append(ids[k])
                open_[k + 1 :] &= np.clip(units[k + 1 :] @ units[k], -1, 1) < threshold
        return pa.table({"id": pa.array(new, pa.int64())})

    return settled


def new_tags(names: DataFrame, threshold: float = MERGE_THRESHOLD, block: int | None = None) -> DataFrame:
    """(id): which of the names (tenant_id, id, embedding), in order of id, become tags: those that no earlier tag of the tenant is near to.

    In each round the first block of every tenant's open names is settled, by one task a tenant, and all other open names that are near a tag made there are no longer open; that
    search is dealt out in tiles. A round takes at least a block of names from each tenant, and as many more as resemble them; no pair of names is ever written.
    """
    block = block or BLOCK
    open_, made = _sized(names, "id"), []
    while True:
        order = W.partitionBy(*GROUP).orderBy("id")
        first = shared.cut(open_.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= block).drop("nth"))
        if first.isEmpty():
            break
        tags = shared.cut(first.groupBy(*GROUP).applyInArrow(_settle(threshold), "id long"))
        made.append(tags)
        last = first.groupBy(*GROUP).agg(F.max("id").alias("last"))
        rest = open_.join(last, GROUP).where("id > last").drop("last")
        near = nearest(rest.withColumnRenamed("id", "name_id"), first.join(tags, "id", "left_semi").withColumnRenamed("id", "tag_id"), threshold)
        open_ = shared.cut(rest.join(near.select(F.col("name_id").alias("id")), "id", "left_anti"))
    return reduce(DataFrame.unionByName, made) if made else names.select("id").limit(0)


def canonicalize(names: DataFrame, tags: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """(tenant_id, seq, name, tag, is_new): names (tenant_id, seq, name, embedding) in order of seq and name take a known tag's name by equality, then by similarity, or become
    tags themselves that later names can take. tags: (tenant_id, name, embedding).

    Rows get numbers in that order by a range sort over all tenants, so one tenant may have any share of them. What a name is told depends on the set of tags before it only: the
    names near no given tag are settled by new_tags, then every other name looks for the nearest tag with a smaller number. Similarities that agree to nine digits are ties, which the
    earlier tag wins. Names without a usable vector match by equality only.
    """
    given = tags.select("tenant_id", F.lit(-1).cast("long").alias("seq"), "name", "embedding").dropDuplicates(["tenant_id", "name"])
    rows = given.unionByName(names.select("tenant_id", F.col("seq").cast("long"), "name", "embedding"))
    numbered = shared.cut(rows.orderBy("tenant_id", "seq", "name").withColumn("id", F.monotonically_increasing_id()))
    # Equal names of a tenant share the fate of their first.
    firsts = numbered.groupBy("tenant_id", "name").agg(F.min("id").alias("id"))
    heads = shared.cut(numbered.join(firsts.select("id"), "id", "left_semi"))
    known, asked = heads.where("seq < 0"), heads.where("seq >= 0")
    near_known = nearest(asked.withColumnRenamed("id", "name_id"), known.withColumnRenamed("id", "tag_id"), threshold).select(F.col("name_id").alias("id"))
    usable = asked.where(F.exists("embedding", lambda v: v != 0))
    new = new_tags(usable.join(near_known, "id", "left_anti").select("tenant_id", "id", "embedding"), threshold)
    new = shared.cut(new.unionByName(asked.join(usable.select("id"), "id", "left_anti").select("id")))
    settled = known.unionByName(heads.join(new, "id", "left_semi"))
    taken = nearest(asked.join(new, "id", "left_anti").withColumnRenamed("id", "name_id"), settled.withColumnRenamed("id", "tag_id"), threshold, earlier=True)
    told = settled.select(F.col("id").alias("head"), F.col("id").alias("to")).unionByName(taken.select(F.col("name_id").alias("head"), F.col("tag_id").alias("to")))
    labelled = told.join(settled.select(F.col("id").alias("to"), F.col("name").alias("tag")), "to").join(new.select(F.col("id").alias("head"), F.lit(True).alias("fresh")), "head", "left")
    fates = labelled.join(heads.select(F.col("id").alias("head"), "tenant_id", "name"), "head").select("tenant_id", "name", "head", "tag", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    asked_rows = numbered.where("seq >= 0").select("tenant_id", "seq", "name", "id")
    return asked_rows.join(fates, ["tenant_id", "name"]).select("tenant_id", "seq", "name", "tag", (F.col("fresh") & (F.col("id") == F.col("head"))).alias("is_new"))


def resolve_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names with the tag_id of their alias, null where there is none."""
    return names.join(aliases.select(F.col("alias").alias("name"), "tag_id"), "name", "left")


def merge(document_tags: DataFrame, source: int, target: int) -> DataFrame:
    """One tag's documents moved to another, without a second row for documents that have both; a lock on either stays."""
    moved = document_tags.withColumn("tag_id", F.when(F.col("tag_id") == source, target).otherwise(F.col("tag_id")))
    return moved.groupBy("document_id", "tag_id").agg(F.max("source").alias("source"), F.max("locked").alias("locked"))


def merge_tags(tags: DataFrame, aliases: DataFrame, document_tags: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, aliases, document_tags) after one tag was merged into another: its documents and aliases go over, its name becomes an alias, its row is gone. aliases: (alias, tag_id); an alias that the
    target has already stays once. A tag merged into itself changes nothing."""
    if source == target:
        return tags, aliases, document_tags
    own = tags.where(F.col("tag_id") == source).select(F.col("name").alias("alias"), F.lit(target).cast("long").alias("tag_id"))
    moved = aliases.select("alias", F.when(F.col("tag_id") == source, target).otherwise(F.col("tag_id")).alias("tag_id"))
    return tags.where(F.col("tag_id") != source), moved.unionByName(own).distinct(), merge(document_tags, source, target)


def of_documents(document_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(document_id, tags): sorted names."""
    return document_tags.join(tags.select("tag_id", "name"), "tag_id").groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))


def attach(document_tags: DataFrame, added: DataFrame, by_user: bool) -> DataFrame:
    """Rows added; a user's rows are locked and take over rows of the same document and tag, a model's leave them."""
    fresh = added.select("document_id", "tag_id", F.lit("user" if by_user else "llm").alias("source"), F.lit(by_user).alias("locked"))
    keys = ["document_id", "tag_id"]
    if by_user:
        return document_tags.join(fresh, keys, "left_anti").unionByName(fresh.distinct())
    return document_tags.unionByName(fresh.join(document_tags, keys, "left_anti").distinct())


def clear_model_tags(document_tags: DataFrame, documents: DataFrame) -> DataFrame:
    """Without the given documents' unlocked model tags."""
    marked = documents.select("document_id", F.lit(True).alias("cleared")).distinct()
    return document_tags.join(marked, "document_id", "left").where(~(F.coalesce("cleared", F.lit(False)) & (F.col("source") == "llm") & ~F.col("locked"))).drop("cleared")


def retag(document_tags: DataFrame, proposed: DataFrame) -> DataFrame:
    """Model tags of the proposed documents replaced; locked ones stay."""
    return attach(clear_model_tags(document_tags, proposed), proposed, by_user=False)


def keywords(documents: DataFrame, most: int = 5) -> DataFrame:
    """(document_id, tags): the terms with the largest tf-idf, the tagger that needs no model.

    Words are counted in their row, as runs of the sorted words, and the best terms are told apart in the task that has the document. What is shuffled is a row for each term and task and most rows for
    each document. Rows of one id are one document.
    """
    words = documents.select("document_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    again = shared.cut(documents.groupBy("document_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("document_id").alias("again")))
    if not again.isEmpty():
        same = F.col("document_id").eqNullSafe(F.col("again"))
        whole = words.join(again, same, "left_semi").groupBy("document_id").agg(F.flatten(F.collect_list("w")).alias("w"))
        words = words.join(again, same, "left_anti").unionByName(whole)
    rows = words.select("document_id", F.array_sort("w").alias("w"))
    rows = rows.withColumn("at", F.expr("filter(sequence(0, size(w)), i -> i = 0 OR i = size(w) OR w[i] != w[i - 1])"))  # a column of its own, as in a lambda function it would be computed for every word
    tf = rows.select("document_id", F.inline(F.expr("transform(sequence(0, size(at) - 2), k -> struct(w[at[k]] AS term, at[k + 1] - at[k] AS tf))")))
    df = shared.cut(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    total = documents.count()
    scored = tf.join(F.broadcast(df) if df.count() <= TERMS_BROADCAST else df, "term").withColumn("score", F.col("tf") * F.log(F.lit(float(total + 1)) / F.col("df")))
    best = scored.withColumn("nth", F.row_number().over(W.partitionBy("document_id").orderBy(F.round("score", 9).desc(), "term"))).where(F.col("nth") <= most)
    return best.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("nth", "term"))).alias("t")).select("document_id", F.transform("t", lambda x: x["term"]).alias("tags"))
