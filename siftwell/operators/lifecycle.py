"""Document lifecycle on immutable files: snapshot writes, versions, source sync, orphans, integrity samples, tenant deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import schedule
from ..sources.snapshots import Store


def upsert_last(current: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """current with incoming rows over it; of several incoming rows of a key the last by seq wins. incoming has seq besides current's columns."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(seq).desc()))
    last = incoming.withColumn("nth", nth).where("nth = 1").select(*current.columns)
    return current.join(last, keys, "left_anti").select(*current.columns).unionByName(last)


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current with the incoming rows whose key it lacks, one of each key."""
    return current.unionByName(incoming.join(current, keys, "left_anti").dropDuplicates(keys).select(*current.columns))


def ingest_snapshot(chunks: DataFrame, files: DataFrame, new_chunks: DataFrame, new_files: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) after documents were ingested anew: incoming files replace rows of the same id and their chunks; a re-ingested document's other files and chunks are superseded, not deleted."""
    touched = new_files.select("document_id").distinct()
    stamp = F.lit(as_of).cast("timestamp_ntz")

    def after(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = old.join(new_files.select("file_id"), "file_id", "left_anti")
        gone = rest.join(touched.withColumn("touched", F.lit(True)), "document_id", "left")
        kept = gone.withColumn("superseded_at", F.when(F.col("touched") & F.col("superseded_at").isNull(), stamp).otherwise(F.col("superseded_at"))).select(*old.columns)
        return kept.unionByName(new.select(*old.columns))

    return after(files, new_files), after(chunks, new_chunks)


INGEST_PARTS = 64


def commit_ingest(store: Store, new_files: DataFrame, new_chunks: DataFrame, as_of: str, writer: str | None = None, batch: int | None = None) -> int:
    """ingest_snapshot of a store's relations files and chunks as one commit: readers see both as they were or both as they are now. Only the parts that the documents lie in are read and
    written; two ingests of one part are a Conflict for the later one; a writer's batch that is repeated changes nothing. Returns the number of the version."""
    t = store.begin()
    if writer is not None and batch is not None and t.base["writers"].get(writer, -1) >= batch:
        return t.base["number"]
    part = F.pmod(F.xxhash64("document_id"), F.lit(INGEST_PARTS)).cast("int")
    parts = sorted(r["p"] for r in new_files.select(part.alias("p")).distinct().collect())  # INGEST_PARTS at most
    old_files, old_chunks = (t.read(name, parts) if t.has(name) else new.limit(0) for name, new in (("files", new_files), ("chunks", new_chunks)))
    files, chunks = ingest_snapshot(old_chunks, old_files, new_chunks, new_files, as_of)
    return t.replace("files", files, part, parts).replace("chunks", chunks, part, parts).commit(writer, batch)


def snapshot_version(versions: DataFrame, documents: DataFrame, tags: DataFrame, chunk_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, documents) with the current state of documents written down under their version, unless it is there, and their version one up."""
    state = documents.join(tags, "document_id", "left").join(chunk_counts, "document_id", "left")
    rows = state.select("document_id", F.col("current_version").alias("version_number"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags_snapshot"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return insert_new(versions, rows, ["document_id", "version_number"]), documents.withColumn("current_version", F.col("current_version") + 1)


def history(observations: DataFrame) -> DataFrame:
    """(document_id, version_number, sha256, valid_from, valid_to): observations (document_id, sha256, seen_at) folded to the times at which the content changed."""
    order = W.partitionBy("document_id").orderBy("seen_at")
    changed = observations.withColumn("last", F.lag("sha256").over(order)).where("last is null or last != sha256").drop("last")
    return changed.select("document_id", F.row_number().over(order).alias("version_number"), "sha256", F.col("seen_at").alias("valid_from"), F.lead("seen_at").over(order).alias("valid_to"))


def due_sources(documents: DataFrame, as_of: str, least_seconds: int, limit: int = 50) -> DataFrame:
    """The sources to be fetched again, longest due first, with the time of the fetch after."""
    now = F.lit(as_of).cast("timestamp_ntz")
    due = documents.where(F.col("next_fetch_at") <= now).orderBy("next_fetch_at", "document_id").limit(limit)
    return due.select("document_id", "next_fetch_at", schedule.next_fetch(now, F.col("interval_seconds"), least_seconds).alias("then"))


def refetch_action(fetches: DataFrame, base: int, cap: int) -> DataFrame:
    """fetches (document_id, ok, old_sha, new_sha, failures) with action (unchanged, changed, retry, paused), failures and wait_seconds (null unless retry)."""
    failures = F.when(F.col("ok"), 0).otherwise(F.col("failures") + 1)
    wait = schedule.refetch_backoff(failures, base, cap)
    action = F.when(F.col("ok") & (F.col("old_sha") == F.col("new_sha")), "unchanged").when(F.col("ok"), "changed").when(wait.isNull(), "paused").otherwise("retry")
    return fetches.select("document_id", action.alias("action"), failures.cast("int").alias("failures"), F.when(~F.col("ok"), wait).alias("wait_seconds"))


def orphans(blobs: DataFrame, files: DataFrame, as_of: str, grace_hours: int) -> DataFrame:
    """(key, what): blobs without a file that are older than the grace, and files without a blob."""
    old = blobs.where(F.col("modified_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval '{grace_hours}' hour"))
    loose = old.select("key").join(files.select("key"), "key", "left_anti").select("key", F.lit("orphan").alias("what"))
    missing = files.select("key").join(blobs.select("key"), "key", "left_anti").select("key", F.lit("missing").alias("what")).distinct()
    return loose.unionByName(missing)


def integrity_sample(files: DataFrame, day_of_year: int, percent: int) -> DataFrame:
    """ceil(n * percent / 100) of each tenant's files in id order, beginning at a place that moves on with the day, around the end."""
    order = W.partitionBy("tenant_id").orderBy("file_id")
    placed = files.withColumn("at", F.row_number().over(order) - 1).join(files.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")), "tenant_id")
    take = F.ceil(F.col("n") * percent / 100)
    return placed.where(F.pmod(F.col("at") - F.lit(day_of_year) * take % F.col("n"), F.col("n")) < take).drop("at", "n")


def verify(files: DataFrame) -> DataFrame:
    """(file_id, intact): whether the bytes have the recorded digest."""
    return files.select("file_id", F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)).alias("intact"))


def exact_file_sets(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request_id, document_id) of documents whose live files are exactly the wanted ones. files: (document_id, page_no, sha256, superseded_at); wanted: (request_id, page_no, sha256). Null pages match null pages."""
    live = files.where("superseded_at is null")
    sizes = live.groupBy("document_id").agg(F.count(F.lit(1)).alias("has"))
    need = wanted.groupBy("request_id").agg(F.count(F.lit(1)).alias("need"))
    met = wanted.alias("w").join(live.alias("f"), F.col("w.sha256").eqNullSafe(F.col("f.sha256")) & F.col("w.page_no").eqNullSafe(F.col("f.page_no")))
    hits = met.groupBy("w.request_id", "f.document_id").agg(F.count(F.lit(1)).alias("hit"))
    return hits.join(sizes, "document_id").join(need, "request_id").where("hit = has and hit = need").select("request_id", "document_id")


def shred(relations: dict[str, DataFrame], tenant: int) -> dict[str, DataFrame]:
    """All relations without a tenant's rows; those without tenant_id go by the documents that go, and those without either stay. Rows of no tenant stay."""
    lost = relations["documents"].where(F.col("tenant_id") == tenant).select("document_id")

    def without(df: DataFrame) -> DataFrame:
        if "tenant_id" in df.columns:
            return df.where(~F.col("tenant_id").eqNullSafe(tenant))
        return df.join(lost, "document_id", "left_anti") if "document_id" in df.columns else df

    return {name: without(df) for name, df in relations.items()}


def tombstone(tenants: DataFrame, tenant: int, as_of: str) -> DataFrame:
    return tenants.where(F.col("tenant_id") == tenant).select("tenant_id", "slug", "name", F.lit(as_of).cast("timestamp_ntz").alias("deleted_at"))


def past_due(tenants: DataFrame, as_of: str, days: int) -> DataFrame:
    """tenants with billing_status suspended where it was past_due for more than so many days."""
    late = (F.col("billing_status") == "past_due") & (F.col("past_due_since") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval '{days}' day"))
    return tenants.withColumn("billing_status", F.when(late, "suspended").otherwise(F.col("billing_status")))


def staleness(rows: DataFrame, hours: float) -> DataFrame:
    return rows.withColumn("stale", schedule.backup_is_stale(F.col("age_hours"), hours))


def line_changes(old: Column, new: Column) -> Column:
    """struct<added, removed>: distinct lines that only one of two texts has; the summary that needs no model."""
    a, b = F.split(F.coalesce(old, F.lit("")), "\n"), F.split(F.coalesce(new, F.lit("")), "\n")
    return F.struct(F.size(F.array_except(b, a)).alias("added"), F.size(F.array_except(a, b)).alias("removed"))
