"""The job queue as state transitions on a jobs relation, against an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import schedule

REAP_LIMIT = 50
IDS_BROADCAST = 10_000
TENANT_PENDING, GLOBAL_PENDING = 200, 2000


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def claim_order(as_of: str) -> list[Column]:
    priority = schedule.effective_priority(F.col("priority"), schedule.age_seconds(_at(as_of), F.col("created_at")))
    return [priority.desc(), F.col("run_after").asc(), F.col("job_id").asc()]


def claimable(jobs: DataFrame, as_of: str, kinds: list[str] | None = None) -> DataFrame:
    out = jobs.where(F.col("status").isin("queued", "failed") & (F.col("run_after") <= _at(as_of)))
    return out.where(F.col("kind").isin(*kinds)) if kinds is not None else out


def next_jobs(jobs: DataFrame, as_of: str, n: int, kinds: list[str] | None = None) -> DataFrame:
    """The n jobs to be claimed next, best first. The lock of a live queue has no place here: one driver decides."""
    return claimable(jobs, as_of, kinds).orderBy(*claim_order(as_of)).limit(n)


def _marked(jobs: DataFrame, ids: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """jobs with a mark on those of ids; so few ids, where their number is known, are broadcast."""
    marks = ids.select("job_id", F.lit(True).alias(name)).distinct()
    joined = jobs.join(F.broadcast(marks) if rows is not None and rows <= IDS_BROADCAST else marks, "job_id", "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(False)))


def _set(jobs: DataFrame, mark: Column, **values: Column) -> DataFrame:
    """New values where the mark holds, the old ones elsewhere."""
    return jobs.withColumns({c: F.when(mark, v).otherwise(F.col(c)) for c, v in values.items()})


def _free(jobs: DataFrame, mark: Column, **values: Column) -> DataFrame:
    """As _set, and nobody's lease any more."""
    return _set(jobs, mark, lease_expires_at=F.lit(None).cast("timestamp_ntz"), locked_by=F.lit(None).cast("string"), **values)


def claim(jobs: DataFrame, as_of: str, n: int, worker: str, lease_seconds: int, kinds: list[str] | None = None) -> DataFrame:
    """jobs with the next n running under a lease of the worker."""
    lease = _at(as_of) + F.make_dt_interval(secs=F.lit(lease_seconds))
    return _set(_marked(jobs, next_jobs(jobs, as_of, n, kinds), "taken", n), F.col("taken"), status=F.lit("running"), lease_expires_at=lease, locked_by=F.lit(worker)).drop("taken")


def fail(jobs: DataFrame, failures: DataFrame, as_of: str) -> DataFrame:
    """jobs after failures (job_id, permanent) of running ones: one more attempt, dead or failed with a doubled wait, and no lease. Other jobs can't fail."""
    told = failures.groupBy("job_id").agg(F.max(F.coalesce("permanent", F.lit(False))).alias("permanent"))
    joined = jobs.join(told, "job_id", "left")
    hit, attempts = F.col("permanent").isNotNull() & (F.col("status") == "running"), F.col("attempts") + 1
    status = schedule.failed_status(attempts, F.col("permanent"))
    wait = _at(as_of) + F.make_dt_interval(secs=schedule.backoff_seconds(attempts))
    return _free(joined, hit, status=status, attempts=attempts, run_after=F.when(status == "failed", wait).otherwise(F.col("run_after"))).drop("permanent")


def complete(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """The running ones of done (job_id) are done; jobs that don't run stay as they are."""
    return _set(_marked(jobs, done, "hit"), F.col("hit") & (F.col("status") == "running"), status=F.lit("done")).drop("hit")


def extend_lease(jobs: DataFrame, held: DataFrame, worker: str, as_of: str, lease_seconds: int) -> DataFrame:
    """The worker's own running jobs among held (job_id) have a new lease; those that it lost have not."""
    own = F.col("hit") & (F.col("status") == "running") & (F.col("locked_by") == worker)
    return _set(_marked(jobs, held, "hit"), own, lease_expires_at=_at(as_of) + F.make_dt_interval(secs=F.lit(lease_seconds))).drop("hit")


def expired(jobs: DataFrame, as_of: str, limit: int = REAP_LIMIT) -> DataFrame:
    """Running jobs whose lease has run out, oldest first, so many at a time. Without a lease nothing runs out."""
    return jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") < _at(as_of))).orderBy("lease_expires_at", "job_id").limit(limit)


def requeue_crashed(jobs: DataFrame, crashed: DataFrame, as_of: str, rows: int | None = None) -> DataFrame:
    """The running ones of crashed (job_id) may be claimed again at once: failed, without an attempt or a wait."""
    return _free(_marked(jobs, crashed, "hit", rows), F.col("hit") & (F.col("status") == "running"), status=F.lit("failed"), run_after=_at(as_of)).drop("hit")


def reap(jobs: DataFrame, as_of: str, limit: int = REAP_LIMIT) -> DataFrame:
    """Expired jobs, limit of them, are requeued; a crash costs no attempt."""
    return requeue_crashed(jobs, expired(jobs, as_of, limit), as_of, limit)


def orphan_sweep(jobs: DataFrame, as_of: str, worker: str) -> DataFrame:
    """Whatever runs under another worker's name when this worker starts anew is requeued like a crashed job."""
    return _free(jobs, (F.col("status") == "running") & (F.col("locked_by") != worker), status=F.lit("failed"), run_after=_at(as_of))


def _dead_ingests(jobs: DataFrame) -> DataFrame:
    return jobs.where("kind = 'ingest' and status = 'dead' and document_id is not null").select("tenant_id", "document_id").distinct()


def _with_status(rows: DataFrame, keys: DataFrame, status: str, test: Column) -> DataFrame:
    marked = rows.join(keys.select("tenant_id", "document_id", F.lit(True).alias("hit")), ["tenant_id", "document_id"], "left")
    return marked.withColumn("status", F.when(F.col("hit") & test, status).otherwise(F.col("status"))).drop("hit")


def dead_letters(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """documents with status failed where an ingest job of the same tenant is dead and the document isn't ready."""
    return _with_status(documents, _dead_ingests(jobs), "failed", F.col("status") != "ready")


def dead_letter_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """files with status failed where they are pending and an ingest job of their document is dead."""
    return _with_status(files, _dead_ingests(jobs), "failed", F.col("status") == "pending")


def latest_job(jobs: DataFrame, *keys: str) -> DataFrame:
    """(document_id, job_id, status), or other keys, of each document's newest job."""
    keys = keys or ("document_id",)
    best = jobs.groupBy(*keys).agg(F.max_by(F.struct("job_id", "status"), "job_id").alias("j"))
    return best.select(*keys, "j.job_id", "j.status")


def retry_outcomes(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """(tenant_id, document_id, job_id, outcome) of requests (tenant_id, document_id): requeued if the latest ingest job of the tenant's document is dead or failed, else not retryable; no job if there is none."""
    latest = latest_job(jobs.where("kind = 'ingest'"), "tenant_id", "document_id")
    told = requests.select("tenant_id", "document_id").distinct().join(latest, ["tenant_id", "document_id"], "left")
    outcome = F.when(F.col("job_id").isNull(), "no job").when(F.col("status").isin("dead", "failed"), "requeued").otherwise("not retryable")
    return told.select("tenant_id", "document_id", "job_id", outcome.alias("outcome"))


def retry(jobs: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """jobs with the requested documents' latest ingest job, if it is dead or failed, queued anew from now on."""
    again = _marked(jobs, retry_outcomes(jobs, requests).where("outcome = 'requeued'"), "hit")
    return _free(again, F.col("hit"), status=F.lit("queued"), attempts=F.lit(0), run_after=_at(as_of)).drop("hit")


def retried(jobs: DataFrame, requests: DataFrame, documents: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents and files of the requeued ones (jobs as they were before): pending again, unless the document is ready; files only if they failed."""
    again = retry_outcomes(jobs, requests).where("outcome = 'requeued'")
    return _with_status(documents, again, "pending", F.col("status") != "ready"), _with_status(files, again, "pending", F.col("status") == "failed")


def depth(jobs: DataFrame, as_of: str) -> DataFrame:
    """One row: queued, running, active, oldest_seconds (of the queued; zero if there is none)."""
    age = schedule.age_seconds(_at(as_of), F.min(F.when(F.col("status") == "queued", F.col("created_at"))))
    active = F.col("status").isin("queued", "running", "failed")
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(active).alias("active"), F.greatest(F.lit(0), F.coalesce(age, F.lit(0))).cast("long").alias("oldest_seconds"))


def admission(jobs: DataFrame, tenant_cap: int = TENANT_PENDING, global_cap: int = GLOBAL_PENDING) -> DataFrame:
    """(tenant_id, pending, all_pending, admitted): whether a tenant may enqueue one more."""
    mine = jobs.groupBy("tenant_id").agg(F.count_if(F.col("status").isin("queued", "running")).alias("pending"))
    total = jobs.agg(F.count_if(F.col("status").isin("queued", "running")).alias("all_pending"))
    return mine.join(F.broadcast(total)).withColumn("admitted", (F.col("pending") < tenant_cap) & (F.col("all_pending") < global_cap))


def eviction(entries: DataFrame, needed: int) -> DataFrame:
    """Least recently used cache entries (shard, key, size, access_seq) that free needed bytes in each shard: those before which too little was free."""
    order = W.partitionBy("shard").orderBy("access_seq").rowsBetween(W.unboundedPreceding, -1)
    return entries.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("before") < needed).drop("before")
