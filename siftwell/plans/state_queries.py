"""Queue, lifecycle, tag, routing and limiter queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import alerts, export, lifecycle, limits, queue, routing, search, tagging
from . import fixtures as fx
from .registry import query

NOW = f"TIMESTAMP '{fx.JOBS_AS_OF}'"
PRIORITY = f"priority + greatest(0, epoch({NOW}) - epoch(created_at)) // 3600"


def _sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


@query(_sql(f"SELECT job_id, tenant_id, kind FROM jobs WHERE status IN ('queued', 'failed') AND run_after <= {NOW} ORDER BY CAST(floor({PRIORITY}) AS BIGINT) DESC, run_after, job_id LIMIT 100", fx.JOBS))
def queue_claim_order(spark: SparkSession, d: str) -> DataFrame:
    """The hundred jobs that would be claimed next: the limit is the feature."""
    return queue.next_jobs(fx.jobs(spark, d), fx.JOBS_AS_OF, 100).select("job_id", "tenant_id", "kind")


@query(_sql(f"SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status IN ('queued', 'running', 'failed')) AS active, CAST(greatest(0, coalesce(epoch({NOW}) - epoch(min(created_at) FILTER (WHERE status = 'queued')), 0)) AS BIGINT) AS oldest_seconds FROM jobs", fx.JOBS))
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return queue.depth(fx.jobs(spark, d), fx.JOBS_AS_OF)


JOB_COLUMNS = ("job_id", "status", "attempts", "run_after", "lease_expires_at", "locked_by")


def _changed(mark: str, status: str, attempts: str = "attempts", run_after: str = "run_after", lease: str = "NULL", lock: str = "NULL", source: str = "jobs") -> str:
    """SQL of all jobs with new values where the mark holds."""
    put = {"status": status, "attempts": attempts, "run_after": run_after, "lease_expires_at": lease, "locked_by": lock}
    return f"SELECT job_id, {', '.join(f'CASE WHEN {mark} THEN {v} ELSE {c} END AS {c}' if v != c else c for c, v in put.items())} FROM {source}"


@query(_sql(_changed("status = 'running'", "CASE WHEN job_id % 7 = 0 OR attempts + 1 >= 5 THEN 'dead' ELSE 'failed' END", "attempts + 1", f"CASE WHEN job_id % 7 = 0 OR attempts + 1 >= 5 THEN run_after ELSE {NOW} + to_seconds(30 * CAST(pow(2, attempts) AS BIGINT)) END"), fx.JOBS))
def job_backoff(spark: SparkSession, d: str) -> DataFrame:
    """All jobs are told to fail, every seventh for good; those that run do."""
    jobs = fx.jobs(spark, d)
    return queue.fail(jobs, jobs.select("job_id", (F.col("job_id") % 7 == 0).alias("permanent")), fx.JOBS_AS_OF).select(*JOB_COLUMNS)


@query(_sql(_changed("taken.job_id IS NOT NULL", "'running'", lease=f"{NOW} + INTERVAL 600 SECOND", lock="'worker:9'", source=f"jobs LEFT JOIN (SELECT job_id FROM jobs WHERE status IN ('queued', 'failed') AND run_after <= {NOW} AND kind IN ('ingest', 'export') ORDER BY CAST(floor({PRIORITY}) AS BIGINT) DESC, run_after, job_id LIMIT 100) taken USING (job_id)"), fx.JOBS))
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    """A hundred jobs of two kinds are claimed; other workers' jobs keep their locks."""
    return queue.claim(fx.jobs(spark, d), fx.JOBS_AS_OF, 100, "worker:9", 600, ["ingest", "export"]).select(*JOB_COLUMNS)


@query(_sql(_changed("status = 'running' AND job_id % 2 = 0", "'done'", lease="lease_expires_at", lock="locked_by"), fx.JOBS))
def job_complete(spark: SparkSession, d: str) -> DataFrame:
    """Every second job is reported as done; only running ones are."""
    jobs = fx.jobs(spark, d)
    return queue.complete(jobs, jobs.where("job_id % 2 = 0").select("job_id")).select(*JOB_COLUMNS)


@query(_sql(_changed("status = 'running' AND locked_by = 'worker:1'", "status", lease=f"{NOW} + INTERVAL 600 SECOND", lock="locked_by"), fx.JOBS))
def job_extend_lease(spark: SparkSession, d: str) -> DataFrame:
    """One worker extends the leases of all jobs that it ever had; its own running ones are extended."""
    jobs = fx.jobs(spark, d)
    return queue.extend_lease(jobs, jobs.select("job_id"), "worker:1", fx.JOBS_AS_OF, 600).select(*JOB_COLUMNS)


@query(_sql(_changed("status = 'running' AND locked_by IS NOT NULL AND locked_by <> 'worker:1'", "'failed'", run_after=NOW), fx.JOBS))
def job_orphan_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A worker starts anew: what runs under other names is requeued."""
    return queue.orphan_sweep(fx.jobs(spark, d), fx.JOBS_AS_OF, "worker:1").select(*JOB_COLUMNS)


DEAD = "SELECT document_id, tenant_id FROM jobs WHERE kind = 'ingest' AND status = 'dead'"


def _staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents and files before the transitions: a third of the documents is ready, files are pending or failed or ready. Tenants are those of the document's jobs."""
    docs = fx.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 20).alias("tenant_id"))
    status = F.element_at(F.array(F.lit("ready"), F.lit("pending"), F.lit("failed")), (F.col("document_id") % 3 + 1).cast("int"))
    file_status = F.element_at(F.array(F.lit("pending"), F.lit("failed"), F.lit("ready")), (F.floor(F.col("document_id") / 3) % 3 + 1).cast("int"))
    return docs.withColumn("status", status), docs.withColumn("file_id", F.col("document_id")).withColumn("status", file_status)


STAGED = """staged AS (SELECT doc_id AS document_id, doc_id % 20 AS tenant_id, ['ready', 'pending', 'failed'][doc_id % 3 + 1] AS status, ['pending', 'failed', 'ready'][doc_id // 3 % 3 + 1] AS file_status FROM documents)"""


@query(_sql(f"SELECT document_id, CASE WHEN status <> 'ready' AND (document_id, tenant_id) IN ({DEAD}) THEN 'failed' ELSE status END AS status, CASE WHEN file_status = 'pending' AND (document_id, tenant_id) IN ({DEAD}) THEN 'failed' ELSE file_status END AS file_status FROM staged", STAGED, fx.JOBS))
def dead_letter_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents and files whose ingest job died."""
    docs, files = _staged(spark, d)
    jobs = fx.jobs(spark, d)
    return queue.dead_letters(jobs, docs).join(queue.dead_letter_files(jobs, files).select("document_id", F.col("status").alias("file_status")), "document_id").select("document_id", "status", "file_status")


@query(_sql("SELECT document_id, max(job_id) AS job_id, arg_max(status, job_id) AS status FROM jobs GROUP BY document_id", fx.JOBS))
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return queue.latest_job(fx.jobs(spark, d))


@query(_sql("SELECT tenant_id, count(*) FILTER (WHERE status IN ('queued', 'running')) AS pending, (SELECT count(*) FROM jobs WHERE status IN ('queued', 'running')) AS all_pending, count(*) FILTER (WHERE status IN ('queued', 'running')) < 200 AND (SELECT count(*) FROM jobs WHERE status IN ('queued', 'running')) < 2000 AS admitted FROM jobs GROUP BY tenant_id", fx.JOBS))
def admission(spark: SparkSession, d: str) -> DataFrame:
    return queue.admission(fx.jobs(spark, d))


@query(_sql(_changed("lost.job_id IS NOT NULL", "'failed'", run_after=NOW, source=f"jobs LEFT JOIN (SELECT job_id FROM jobs WHERE status = 'running' AND lease_expires_at < {NOW} ORDER BY lease_expires_at, job_id LIMIT 50) lost USING (job_id)"), fx.JOBS))
def reap_expired(spark: SparkSession, d: str) -> DataFrame:
    """The fifty jobs whose lease ran out first may be claimed again: the limit is the feature."""
    return queue.reap(fx.jobs(spark, d), fx.JOBS_AS_OF).select(*JOB_COLUMNS)


ASKED = """latest AS (SELECT tenant_id, document_id, max(job_id) AS job_id, arg_max(status, job_id) AS last FROM jobs WHERE kind = 'ingest' GROUP BY ALL),
    asked AS (SELECT DISTINCT tenant_id, document_id FROM jobs WHERE document_id % 2 = 0),
    requeued AS (SELECT * FROM asked JOIN latest USING (tenant_id, document_id) WHERE last IN ('dead', 'failed'))"""


def _asked(jobs: DataFrame) -> DataFrame:
    return jobs.where("document_id % 2 = 0").select("tenant_id", "document_id").distinct()


@query(_sql(_changed("job_id IN (SELECT job_id FROM requeued)", "'queued'", "0", NOW), fx.JOBS, ASKED))
def retry_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every second document of every tenant is asked for again: its latest ingest job starts anew if it failed or died."""
    jobs = fx.jobs(spark, d)
    return queue.retry(jobs, _asked(jobs), fx.JOBS_AS_OF).select(*JOB_COLUMNS)


@query(_sql("SELECT tenant_id, document_id, job_id, CASE WHEN job_id IS NULL THEN 'no job' WHEN last IN ('dead', 'failed') THEN 'requeued' ELSE 'not retryable' END AS outcome FROM asked LEFT JOIN latest USING (tenant_id, document_id)", fx.JOBS, ASKED))
def retry_outcomes(spark: SparkSession, d: str) -> DataFrame:
    jobs = fx.jobs(spark, d)
    return queue.retry_outcomes(jobs, _asked(jobs))


@query(_sql("SELECT document_id, CASE WHEN status <> 'ready' AND r THEN 'pending' ELSE status END AS status, CASE WHEN file_status = 'failed' AND r THEN 'pending' ELSE file_status END AS file_status FROM (SELECT *, (document_id, tenant_id) IN (SELECT document_id, tenant_id FROM requeued) AS r FROM staged)", STAGED, fx.JOBS, ASKED))
def retry_staged(spark: SparkSession, d: str) -> DataFrame:
    """What a retry does to documents and files."""
    jobs = fx.jobs(spark, d)
    docs, files = queue.retried(jobs, _asked(jobs), *_staged(spark, d))
    return docs.join(files.select("document_id", F.col("status").alias("file_status")), "document_id").select("document_id", "status", "file_status")


@query(_sql("SELECT shard, key, size FROM (SELECT tenant_id AS shard, sha256 AS key, size_bytes AS size, document_id, sum(size_bytes) OVER (PARTITION BY tenant_id ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM docs) WHERE coalesce(before, 0) < 20000", fx.DOCUMENTS))
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    entries = fx.documents(spark, d).select(F.col("tenant_id").alias("shard"), F.col("sha256").alias("key"), F.col("size_bytes").alias("size"), F.col("document_id").alias("access_seq"))
    return queue.eviction(entries, 20_000).select("shard", "key", "size")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    page = fx.read(spark, d, "pages")
    due = F.lit(fx.AS_OF).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("page_id") % 11 - 5).cast("int"))
    return page.select(F.col("page_id").alias("document_id"), due.alias("next_fetch_at"), F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 7 * 1800).alias("interval_seconds"))


@query(f"""
    WITH s AS (SELECT page_id AS document_id, TIMESTAMP '{fx.AS_OF}' + to_hours(CAST(page_id % 11 - 5 AS INTEGER)) AS next_fetch_at, CASE WHEN page_id % 4 <> 0 THEN page_id % 7 * 1800 END AS seconds FROM pages)
    SELECT document_id, next_fetch_at, TIMESTAMP '{fx.AS_OF}' + to_seconds(greatest(3600, coalesce(seconds, 3600))) AS "then"
    FROM s WHERE next_fetch_at <= TIMESTAMP '{fx.AS_OF}' ORDER BY next_fetch_at, document_id LIMIT 50
""")
def due_sources(spark: SparkSession, d: str) -> DataFrame:
    """The fifty sources that are due longest."""
    return lifecycle.due_sources(_sources(spark, d), fx.AS_OF, 3600)


@query("""
    SELECT page_id AS document_id, CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END WHEN page_id % 13 + 1 < 10 THEN 'retry' ELSE 'paused' END AS action,
           CAST(CASE WHEN page_id % 5 <> 0 THEN 0 ELSE page_id % 13 + 1 END AS INTEGER) AS failures,
           CASE WHEN page_id % 5 = 0 AND page_id % 13 + 1 < 10 THEN least(3600, 60 * CAST(pow(2, least(page_id % 13 + 1, 5)) AS BIGINT)) END AS wait_seconds
    FROM pages
""")
def refetch_action(spark: SparkSession, d: str) -> DataFrame:
    page = fx.read(spark, d, "pages")
    new = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    fetches = page.select(F.col("page_id").alias("document_id"), (F.col("page_id") % 5 != 0).alias("ok"), F.sha2("html", 256).alias("old_sha"), F.sha2(new, 256).alias("new_sha"), (F.col("page_id") % 13).alias("failures"))
    return lifecycle.refetch_action(fetches, 60, 3600)


SEEN = """seen AS (
    SELECT page_id AS document_id, sha256(html) AS sha256, TIMESTAMP '2024-01-01' AS seen_at FROM pages
    UNION ALL SELECT page_id, sha256(CASE WHEN page_id % 3 = 0 THEN html || '!' ELSE html END), TIMESTAMP '2024-01-02' FROM pages
    UNION ALL SELECT page_id, sha256(html), TIMESTAMP '2024-01-03' FROM pages
)"""


@query(_sql("""
    SELECT document_id, CAST(row_number() OVER w AS INTEGER) AS version_number, sha256, seen_at AS valid_from, lead(seen_at) OVER w AS valid_to
    FROM (SELECT *, lag(sha256) OVER (PARTITION BY document_id ORDER BY seen_at) AS last FROM seen) WHERE last IS NULL OR last <> sha256 WINDOW w AS (PARTITION BY document_id ORDER BY seen_at)""", SEEN))
def version_history(spark: SparkSession, d: str) -> DataFrame:
    page = fx.read(spark, d, "pages")
    edited = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    days = F.array(*[F.struct(F.sha2(body, 256).alias("sha256"), F.lit(day).cast("timestamp_ntz").alias("seen_at")) for body, day in ((F.col("html"), "2024-01-01"), (edited, "2024-01-02"), (F.col("html"), "2024-01-03"))])
    return lifecycle.history(page.select(F.col("page_id").alias("document_id"), F.inline(days)))


@query(_sql("""
    SELECT key, 'orphan' AS what FROM blobs ANTI JOIN files USING (key) WHERE modified_at < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR
    UNION ALL SELECT DISTINCT key, 'missing' FROM files ANTI JOIN blobs USING (key)""",
    "blobs AS (SELECT doc_id || '/' || sha256(text) AS key, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS modified_at FROM documents WHERE doc_id % 9 <> 0)", "files AS (SELECT doc_id || '/' || sha256(text) AS key FROM documents WHERE doc_id % 7 <> 0)"))
def orphan_gc(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.read(spark, d, "documents").select("doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("key"))
    stamp = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return lifecycle.orphans(docs.where("doc_id % 9 != 0").select("key", stamp.alias("modified_at")), docs.where("doc_id % 7 != 0").select("key"), fx.AS_OF, 24)


@query(_sql("""
    SELECT tenant_id, file_id FROM (SELECT tenant_id, file_id, row_number() OVER (PARTITION BY tenant_id ORDER BY file_id) - 1 AS place, count(*) OVER (PARTITION BY tenant_id) AS n FROM docs)
    WHERE (place - 31 * CAST(ceil(n * 10 / 100) AS BIGINT) % n + n) % n < ceil(n * 10 / 100)""", fx.DOCUMENTS))
def integrity_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of each tenant's files, another one every day: the sample is the feature."""
    return lifecycle.integrity_sample(fx.documents(spark, d), 31, 10).select("tenant_id", "file_id")


@query("SELECT doc_id AS file_id, doc_id % 10 <> 0 AS intact FROM documents")
def integrity_verify(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.read(spark, d, "documents")
    told = F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.sha2("text", 256))
    return lifecycle.verify(docs.select(F.col("doc_id").alias("file_id"), told.alias("sha256"), F.col("text").cast("binary").alias("content")))


SETS = """sets AS (SELECT doc_id // 3 AS document_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 END AS page_no, sha256(text) AS sha, doc_id % 17 = 0 AS gone FROM documents)"""


@query(_sql("""
    SELECT w.document_id AS request_id, f.document_id FROM (SELECT * FROM sets WHERE document_id % 2 = 0) w JOIN (SELECT * FROM sets WHERE NOT gone) f ON w.sha = f.sha AND w.page_no IS NOT DISTINCT FROM f.page_no
    GROUP BY w.document_id, f.document_id
    HAVING count(*) = (SELECT count(*) FROM sets s WHERE s.document_id = f.document_id AND NOT gone) AND count(*) = (SELECT count(*) FROM sets s WHERE s.document_id = w.document_id)""", SETS))
def exact_fileset_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents of three pages; every second set is asked for."""
    docs = fx.read(spark, d, "documents")
    pages = docs.select(F.floor(F.col("doc_id") / 3).alias("document_id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 3).alias("page_no"), F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 17 == 0, F.lit(1)).alias("superseded_at"))
    return lifecycle.exact_file_sets(pages, pages.where("document_id % 2 = 0").select(F.col("document_id").alias("request_id"), "page_no", "sha256"))


@query(_sql("""
    SELECT 'document' AS type, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM docs
    UNION ALL SELECT 'tag', count(DISTINCT name), 0 FROM doc_tags UNION ALL SELECT 'document_tag', count(*), 0 FROM doc_tags""", fx.DOCUMENTS, fx.DOCUMENT_TAGS))
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    return export.manifest({"document": fx.documents(spark, d), "tag": fx.tag_names(spark, d), "document_tag": fx.document_tag_names(spark, d)})


@query()
def export_lines(spark: SparkSession, d: str) -> DataFrame:
    return export.lines({"document": fx.documents(spark, d).drop("text"), "tag": fx.tag_names(spark, d)})


@query(" UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "pages", "events", "orders", "lineitem")))
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return export.row_counts({t: fx.read(spark, d, t) for t in ("documents", "embeddings", "pages", "events", "orders", "lineitem")})


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'second' WHEN o_orderkey % 2 = 0 THEN 'first' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey - 1, 'second' FROM orders WHERE o_orderkey % 4 = 0")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Two loads over a relation: the later row of a key wins, unknown keys are added."""
    rows = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    first = rows.where("id % 2 = 0").select("id", F.lit("first").alias("status"), F.lit(1).alias("seq"))
    second = rows.where("id % 4 = 0").select(F.explode(F.array("id", -F.col("id") - 1)).alias("id"), F.lit("second").alias("status"), F.lit(2).alias("seq"))
    return lifecycle.upsert_last(rows, first.unionByName(second), ["id"], "seq")


@query("SELECT c_custkey AS tenant_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 40 > 14 THEN 'suspended' WHEN c_custkey % 3 = 0 THEN 'past_due' ELSE 'active' END AS billing_status FROM customer")
def past_due_suspension(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit(fx.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("c_custkey") % 40).cast("int"))
    rows = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("tenant_id"), F.when(F.col("c_custkey") % 3 == 0, "past_due").otherwise("active").alias("billing_status"), since.alias("past_due_since"))
    return lifecycle.past_due(rows, fx.AS_OF, 14).select("tenant_id", "billing_status")


@query("""
    WITH v AS (SELECT label % 4 AS tenant_id, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT n.vec_id AS name_id, t.vec_id AS tag_id, list_cosine_similarity(n.e, t.e) AS similarity FROM v n JOIN v t ON n.tenant_id = t.tenant_id AND n.vec_id % 5 <> 0 AND t.vec_id % 5 = 0)
    SELECT name_id, tag_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY round(similarity, 9) DESC, tag_id) AS nth FROM s WHERE similarity >= 0.2) WHERE nth = 1
""")
def tag_nearest(spark: SparkSession, d: str) -> DataFrame:
    names, tags = fx.tag_vectors(spark, d)
    return tagging.nearest(names, tags, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("""
    WITH RECURSIVE v AS (SELECT label % 4 AS tenant_id, vec_id AS id, 'tag ' || vec_id AS name, vec_id % 5 = 0 AS given, embedding::DOUBLE[] AS e FROM embeddings),
    near AS MATERIALIZED (
        SELECT a.tenant_id, a.id, b.id AS other, b.given, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.tenant_id = b.tenant_id AND NOT a.given AND (b.given OR b.id < a.id)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.3
    ), asked AS MATERIALIZED (
        SELECT v.tenant_id, v.id, row_number() OVER (PARTITION BY v.tenant_id ORDER BY v.id) AS nth, coalesce(bool_or(n.given), false) AS covered, coalesce(list(n.other) FILTER (NOT n.given), []) AS earlier
        FROM v LEFT JOIN near n ON n.id = v.id WHERE NOT v.given GROUP BY v.tenant_id, v.id
    ), walk AS (
        SELECT DISTINCT tenant_id, 0::BIGINT AS nth, []::BIGINT[] AS made FROM asked
        UNION ALL
        SELECT w.tenant_id, a.nth, CASE WHEN a.covered OR list_has_any(w.made, a.earlier) THEN w.made ELSE list_append(w.made, a.id) END FROM walk w JOIN asked a ON a.tenant_id = w.tenant_id AND a.nth = w.nth + 1
    ), made AS (SELECT unnest(arg_max(made, nth)) AS id FROM walk GROUP BY tenant_id),
    best AS (
        SELECT id, other FROM (SELECT n.*, row_number() OVER (PARTITION BY n.id ORDER BY s DESC, n.given DESC, CASE WHEN n.given THEN 'tag ' || n.other END, n.other) AS k FROM near n WHERE n.given OR n.other IN (SELECT id FROM made)) WHERE k = 1
    )
    SELECT a.tenant_id, a.id AS seq, 'tag ' || a.id AS name, 'tag ' || CASE WHEN m.id IS NOT NULL THEN a.id ELSE best.other END AS tag, m.id IS NOT NULL AS is_new
    FROM asked a LEFT JOIN made m USING (id) LEFT JOIN best ON best.id = a.id
""")
def tag_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    names, tags = fx.tag_vectors(spark, d)
    return tagging.canonicalize(names.withColumnRenamed("name_id", "seq"), tags, 0.3)


NUMBERED = "numbered AS (SELECT document_id, CASE name WHEN 'long' THEN 1 WHEN 'short' THEN 2 ELSE 3 + ascii(name) % 5 END AS tag_id, source, locked FROM doc_tags)"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("name") == "long", 1).when(F.col("name") == "short", 2).otherwise(3 + F.ascii("name") % 5)
    return fx.document_tag_names(spark, d).select("document_id", tag.alias("tag_id"), "source", "locked")


@query(_sql("SELECT document_id, CASE WHEN tag_id = 1 THEN 4 ELSE tag_id END AS tag_id, max(source) AS source, bool_or(locked) AS locked FROM numbered GROUP BY 1, 2", fx.DOCUMENT_TAGS, NUMBERED))
def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    return tagging.merge(_numbered(spark, d), 1, 4)


@query(_sql("SELECT document_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS tags FROM doc_tags GROUP BY document_id", fx.DOCUMENT_TAGS))
def tags_per_document(spark: SparkSession, d: str) -> DataFrame:
    tags = fx.tag_names(spark, d)
    return tagging.of_documents(fx.document_tag_names(spark, d).join(tags, "name").drop("name"), tags).select("document_id", F.array_join("tags", ",").alias("tags"))


@query(_sql("SELECT DISTINCT document_id, tag_id, source, locked FROM numbered WHERE NOT (document_id % 2 = 0 AND source = 'llm' AND NOT locked) UNION ALL SELECT DISTINCT document_id, CAST(9 AS INTEGER), 'llm', false FROM numbered WHERE document_id % 2 = 0", fx.DOCUMENT_TAGS, NUMBERED))
def retag(spark: SparkSession, d: str) -> DataFrame:
    """Every second document gets tag 9 in place of its unlocked model tags."""
    rows = _numbered(spark, d).distinct()
    return tagging.retag(rows, rows.where("document_id % 2 = 0").select("document_id", F.lit(9).alias("tag_id")).distinct())


@query(r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    best AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / df), 9) DESC, term) AS nth FROM tf JOIN df USING (term))
    SELECT doc_id AS document_id, string_agg(term, ',' ORDER BY nth) AS tags FROM best WHERE nth <= 5 GROUP BY doc_id
""")
def keyword_tags(spark: SparkSession, d: str) -> DataFrame:
    return tagging.keywords(fx.documents(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query(_sql("SELECT document_id FROM docs WHERE document_id IN (SELECT document_id FROM doc_tags WHERE name IN ('fr', 'short') GROUP BY 1 HAVING count(DISTINCT name) = 2)", fx.DOCUMENTS, fx.DOCUMENT_TAGS))
def all_tags_filter(spark: SparkSession, d: str) -> DataFrame:
    tags = fx.tag_names(spark, d)
    return search.with_all_tags(fx.documents(spark, d), fx.document_tag_names(spark, d).join(tags, "name"), tags, ["fr", "short"]).select("document_id")


ROUTES = """routes AS (
        SELECT DISTINCT ['text', 'vision', 'code'][l_orderkey % 3 + 1] AS role, CAST(l_linenumber % 3 AS BIGINT) AS tier, l_partkey AS model_id, CASE WHEN l_linenumber > 3 THEN l_suppkey % 10 END AS tenant_id FROM lineitem
    ), on_routes AS (SELECT r.* FROM routes r JOIN part ON p_partkey = model_id AND p_partkey % 4 <> 0 JOIN supplier ON s_suppkey = p_partkey % 10 + 1 AND s_suppkey % 2 = 1)"""


def _routes(spark: SparkSession, d: str) -> DataFrame:
    line = fx.read(spark, d, "lineitem")
    role = F.element_at(F.array(F.lit("text"), F.lit("vision"), F.lit("code")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    routes = line.select(role.alias("role"), (F.col("l_linenumber") % 3).cast("long").alias("tier"), F.col("l_partkey").alias("model_id"), F.when(F.col("l_linenumber") > 3, F.col("l_suppkey") % 10).alias("tenant_id")).distinct()
    models = fx.read(spark, d, "part").select(F.col("p_partkey").alias("model_id"), (F.col("p_partkey") % 10 + 1).alias("provider_id"), (F.col("p_partkey") % 4 != 0).alias("model_enabled"), F.col("p_retailprice").alias("price_in"), F.col("p_retailprice").alias("price_out"))
    providers = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"), F.lit("local").alias("data_class"), (F.col("s_suppkey") % 2 == 1).alias("provider_enabled"))
    return routing.enabled_routes(routes, models, providers)


@query(_sql("""
    SELECT t.tenant_id, r.role, r.tier, r.model_id, false AS own FROM (SELECT unnest(range(10)) AS tenant_id) t, (SELECT * FROM on_routes WHERE tenant_id IS NULL) r
    WHERE NOT EXISTS (SELECT 1 FROM on_routes o WHERE o.tenant_id = t.tenant_id AND o.role = r.role AND o.tier = r.tier AND o.model_id = r.model_id)
    UNION ALL SELECT tenant_id, role, tier, model_id, true FROM on_routes WHERE tenant_id IS NOT NULL""", ROUTES))
def routing_table(spark: SparkSession, d: str) -> DataFrame:
    return routing.for_tenants(_routes(spark, d), spark.range(10).withColumnRenamed("id", "tenant_id"))


@query(_sql("""
    SELECT w.tenant_id, w.role, r.tier, r.model_id FROM (SELECT DISTINCT unnest(range(12)) AS tenant_id, role FROM routes) w JOIN on_routes r ON r.role = w.role
    AND (r.tenant_id = w.tenant_id OR r.tenant_id IS NULL AND NOT EXISTS (SELECT 1 FROM on_routes o WHERE o.tenant_id = w.tenant_id AND o.role = w.role))""", ROUTES))
def routing_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Twelve tenants' tiers; two have none of their own and take the global ones."""
    routes = _routes(spark, d)
    wanted = spark.range(12).select(F.col("id").alias("tenant_id"), F.explode(F.array(F.lit("text"), F.lit("vision"), F.lit("code"))).alias("role"))
    return routing.tiers(routes, wanted)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return fx.usage_events(spark, d).select(F.col("tenant_id").cast("string").alias("key"), F.col("created_at").alias("ts"), "event_id", F.col("role"), (F.col("value") / 100).alias("cost"), (F.col("role") != "code").alias("ok"))


CALLS = """calls AS MATERIALIZED (
        SELECT CAST(tenant_id AS VARCHAR) AS key, event_id, epoch_us(created_at) / 1000000.0::DOUBLE AS s, value / 100 AS cost, role <> 'code' AS ok,
               row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, event_id) AS nth
        FROM usage
    )"""


def _walked(start: str, step: str, told: str) -> str:
    """SQL that walks each key's calls one by one. step: a SELECT over w, the state so far, and e, the next call."""
    return f"WITH RECURSIVE {fx.USAGE}, {CALLS}, walk AS (SELECT DISTINCT key, 0::BIGINT AS nth, -1::BIGINT AS event_id, {start} FROM calls UNION ALL {step}) SELECT key, event_id, {told} FROM walk WHERE nth > 0"


@query(_walked("[]::DOUBLE[] AS passed, true AS allowed, 0::BIGINT AS retry_after", """
    SELECT key, nth, event_id, CASE WHEN len(p) < 5 THEN list_append(p, s) ELSE p END, len(p) < 5, CASE WHEN len(p) < 5 THEN 0 ELSE greatest(1, CAST(trunc(3600 - (s - p[1])) AS BIGINT)) END
    FROM (SELECT e.key, e.nth, e.event_id, e.s, list_filter(w.passed, lambda t: e.s - t < 3600) AS p FROM walk w JOIN calls e ON e.key = w.key AND e.nth = w.nth + 1)""", "allowed, retry_after"))
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return limits.sliding_log(_calls(spark, d), 5, 3600)


@query(_walked("10.0::DOUBLE AS have, NULL::DOUBLE AS last, true AS allowed, 0.0::DOUBLE AS left_", """
    SELECT key, nth, event_id, CASE WHEN cost <= b THEN least(10.0::DOUBLE, b - cost) ELSE b END, s, cost <= b, round(CASE WHEN cost <= b THEN least(10.0::DOUBLE, b - cost) ELSE b END, 9)
    FROM (SELECT e.*, least(10.0::DOUBLE, w.have + greatest(0.0::DOUBLE, e.s - coalesce(w.last, e.s)) * 0.001::DOUBLE) AS b FROM walk w JOIN calls e ON e.key = w.key AND e.nth = w.nth + 1)""", 'allowed, left_ AS "left"'))
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return limits.token_bucket(_calls(spark, d), 10, 0.001)


@query(_walked("0::BIGINT AS failures, -1.0::DOUBLE AS until, '' AS state", """
    SELECT e.key, e.nth, e.event_id, CASE WHEN e.s < w.until THEN w.failures WHEN e.ok THEN 0 ELSE w.failures + 1 END,
           CASE WHEN e.s < w.until THEN w.until WHEN e.ok OR w.failures + 1 < 2 THEN -1.0::DOUBLE ELSE e.s + 600 END,
           CASE WHEN e.s < w.until THEN 'open' WHEN e.ok OR w.failures + 1 < 2 THEN 'closed' ELSE 'open' END
    FROM walk w JOIN calls e ON e.key = w.key AND e.nth = w.nth + 1""", "state, failures"))
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return limits.circuit_breaker(_calls(spark, d), 2, 600)


@query(_sql("SELECT document_id, nullif(tenant_id, 2) AS tenant_id FROM docs WHERE nullif(tenant_id, 2) IS DISTINCT FROM 1", fx.DOCUMENTS))
def tenant_shred(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay when tenant 1 goes; those of no tenant (2 stands for none here) are not its own."""
    rows = fx.documents(spark, d).select("document_id", F.nullif("tenant_id", F.lit(2)).alias("tenant_id"))
    return lifecycle.shred({"documents": rows}, 1)["documents"]


def _counters(spark: SparkSession, d: str) -> DataFrame:
    """A counter for each type of event and parity of user, which starts anew every day; (series, kind, ts, value)."""
    e = fx.read(spark, d, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_id", F.col("event_type").alias("kind"), F.concat_ws(" ", "event_type", (F.col("user_id") % 2).cast("string")).alias("series"))
    day = W.partitionBy("series", F.floor(F.col("ts") / 86400)).orderBy("ts", "event_id")
    return e.withColumn("value", F.row_number().over(day).cast("double")).groupBy("series", "kind", "ts").agg(F.max("value").alias("value"))


COUNTERS = """samples AS MATERIALIZED (
        SELECT series, kind, ts, max(value) AS value FROM (
            SELECT event_type || ' ' || user_id % 2 AS series, event_type AS kind, epoch_us(ts) / 1000000.0::DOUBLE AS ts, row_number() OVER (PARTITION BY event_type, user_id % 2, date_trunc('day', ts) ORDER BY ts, event_id)::DOUBLE AS value FROM events
        ) GROUP BY ALL
    )"""


def _alert_sql(rule: alerts.Rule, step: int) -> str:
    """The rule over all times of the grid, by a join of every time with the samples of its range."""
    label = rule.by or "series"
    scale = {"rate": f" / {rule.range_seconds}", "increase": ""}.get(rule.kind)
    if scale is None:
        values = f"SELECT {label} AS label, t, sum(v) AS value FROM (SELECT series, kind, t, arg_max(value, ts) AS v FROM met GROUP BY ALL) GROUP BY ALL"
    else:
        values = f"""SELECT {label} AS label, t, sum(grown * (span + least(CASE WHEN a >= 1.1 * mean THEN mean / 2 ELSE a END, CASE WHEN grown > 0 AND first >= 0 THEN span * first / grown ELSE 1e300 END)
                   + CASE WHEN b >= 1.1 * mean THEN mean / 2 ELSE b END) / span{scale}) AS value
            FROM (SELECT series, kind, t, arg_max(value, ts) - arg_min(value, ts) + coalesce(sum(before) FILTER (before_ts > t - {rule.range_seconds} AND value < before), 0) AS grown, arg_min(value, ts) AS first,
                         max(ts) - min(ts) AS span, (max(ts) - min(ts)) / (count(*) - 1) AS mean, min(ts) - (t - {rule.range_seconds}) AS a, t - max(ts) AS b
                  FROM met GROUP BY series, kind, t HAVING count(*) >= 2 AND max(ts) > min(ts)) GROUP BY ALL"""
    return f"""
        WITH {COUNTERS}, told AS (SELECT *, lag(value) OVER w AS before, lag(ts) OVER w AS before_ts FROM samples WINDOW w AS (PARTITION BY series ORDER BY ts)),
        grid AS (SELECT unnest(range((SELECT min(ts)::BIGINT // {step} * {step} FROM samples), (SELECT max(ts)::BIGINT + {rule.range_seconds + step} FROM samples), {step})) AS t),
        met AS (SELECT told.*, t FROM grid JOIN told ON told.ts > t - {rule.range_seconds} AND told.ts <= t), compared AS ({values}),
        hot AS (SELECT *, t - {step} * row_number() OVER (PARTITION BY label ORDER BY t) AS run FROM compared WHERE value > {rule.above}),
        since AS (SELECT *, min(t) OVER (PARTITION BY label, run) AS active_since FROM hot)
        SELECT '{rule.name}' AS rule, label, t, round(value, 6) AS value, active_since, CASE WHEN t - active_since >= {rule.for_seconds} THEN 'firing' ELSE 'pending' END AS state FROM since"""


ALERT_STEP = 1800
RATE_RULE = alerts.Rule("RejectionSpike", "rate", 4 * 3600, 0.00025, 2 * 3600, "kind")
INCREASE_RULE = alerts.Rule("ReapSpike", "increase", 6 * 3600, 2.0, 0)
GAUGE_RULE = alerts.Rule("DepthHigh", "value", 2 * 3600, 4.0, 3600)


@query(_alert_sql(RATE_RULE, ALERT_STEP))
def alert_rate(spark: SparkSession, d: str) -> DataFrame:
    """A rate summed over the series of a label, pending and firing."""
    return alerts.alerts(_counters(spark, d), RATE_RULE, ALERT_STEP).withColumn("value", F.round("value", 6))


@query(_alert_sql(INCREASE_RULE, ALERT_STEP))
def alert_increase(spark: SparkSession, d: str) -> DataFrame:
    """The increase of each counter over its resets, firing at once."""
    return alerts.alerts(_counters(spark, d), INCREASE_RULE, ALERT_STEP).withColumn("value", F.round("value", 6))


@query(_alert_sql(GAUGE_RULE, ALERT_STEP))
def alert_gauge(spark: SparkSession, d: str) -> DataFrame:
    """The newest value of each series against a bound."""
    return alerts.alerts(_counters(spark, d), GAUGE_RULE, ALERT_STEP).withColumn("value", F.round("value", 6))
