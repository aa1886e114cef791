"""Operators that move state or put requests in shape, each on a few rows with a known answer."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from siftwell.operators import chunking, lifecycle, queue, search, tagging

NOW = "2024-01-10 00:00:00"
AT = datetime(2024, 1, 10)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ingest_replaces_files_and_supersedes_the_rest(spark):
    file = "file_id long, document_id long, superseded_at timestamp_ntz"
    chunk = "chunk_id long, file_id long, document_id long, superseded_at timestamp_ntz"
    early = datetime(2024, 1, 1)
    files = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 1, early), (4, 2, None)], file)
    chunks = spark.createDataFrame([(10, 1, 1, None), (20, 2, 1, None), (30, 3, 1, early), (40, 4, 2, None)], chunk)
    new_files, new_chunks = spark.createDataFrame([(1, 1, None)], file), spark.createDataFrame([(11, 1, 1, None), (12, 1, 1, None)], chunk)
    after_files, after_chunks = lifecycle.ingest_snapshot(chunks, files, new_chunks, new_files, NOW)
    assert {r.file_id: r.superseded_at for r in after_files.collect()} == {1: None, 2: AT, 3: early, 4: None}
    assert {r.chunk_id: r.superseded_at for r in after_chunks.collect()} == {11: None, 12: None, 20: AT, 30: early, 40: None}


def test_insert_new_and_snapshots_happen_once(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    assert rows(lifecycle.insert_new(old, spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k long, v string"), ["k"]), "k", "v") == [(1, "a"), (2, "c")]
    docs = spark.createDataFrame([(1, 3), (2, 1)], "document_id long, current_version int")
    tags = spark.createDataFrame([(1, ["x"])], "document_id long, tags array<string>")
    counts = spark.createDataFrame([(1, 7)], "document_id long, chunk_count int")
    known = spark.createDataFrame([(2, 1, ["kept"], 5)], "document_id long, version_number int, tags_snapshot array<string>, chunk_count int")
    versions, moved = lifecycle.snapshot_version(known, docs, tags, counts)
    assert rows(versions, "document_id", "version_number", "tags_snapshot", "chunk_count") == [(1, 3, ["x"], 7), (2, 1, ["kept"], 5)]
    assert rows(moved, "document_id", "current_version") == [(1, 4), (2, 2)]


JOB = "job_id long, tenant_id long, document_id long, kind string, status string, priority int, attempts int, run_after timestamp_ntz, created_at timestamp_ntz, lease_expires_at timestamp_ntz, locked_by string"
PAST, LATER, LEASE = datetime(2024, 1, 9), datetime(2024, 1, 11), datetime(2024, 1, 10, 0, 1)


def jobs_of(spark, *given):
    """(job_id, kind, status, priority, attempts, run_after, locked_by, lease); the document is the job's tenth."""
    return spark.createDataFrame([(j, 1, j // 10, k, s, p, a, r, PAST, lease, by) for j, k, s, p, a, r, by, lease in given], JOB)


def state(df, job):
    r = df.where(F.col("job_id") == job).first()
    return r.status, r.attempts, r.run_after, r.locked_by, r.lease_expires_at


def ids(spark, *given):
    return spark.createDataFrame([(k,) for k in given], "job_id long")


def test_claims_leave_other_workers_jobs(spark):
    jobs = jobs_of(
        spark, (1, "ingest", "running", 1, 0, PAST, "w0", LATER), (2, "ingest", "queued", 5, 0, PAST, None, None), (3, "export", "failed", 5, 1, PAST, None, None),
        (4, "ingest", "queued", 9, 0, LATER, None, None), (5, "ingest", "done", 9, 0, PAST, "w0", PAST), (6, "ingest", "queued", 1, 0, PAST, None, None),
    )
    taken = queue.claim(jobs, NOW, 2, "w1", 60)
    assert rows(taken.where("status = 'running'"), "job_id", "locked_by", "lease_expires_at") == [(1, "w0", LATER), (2, "w1", LEASE), (3, "w1", LEASE)]
    assert state(taken, 5) == ("done", 0, PAST, "w0", PAST)
    assert rows(queue.claim(jobs, NOW, 2, "w1", 60, ["export"]).where("locked_by = 'w1'"), "job_id") == [(3,)]
    again = queue.claim(taken, NOW, 9, "w2", 60)
    assert rows(again.where("status = 'running'"), "job_id", "locked_by") == [(1, "w0"), (2, "w1"), (3, "w1"), (6, "w2")]


def test_leases_of_own_running_jobs_only_are_extended(spark):
    jobs = queue.claim(jobs_of(spark, (1, "ingest", "queued", 1, 0, PAST, None, None), (2, "ingest", "running", 1, 0, PAST, "w0", LATER)), NOW, 1, "w1", 60)
    longer = queue.extend_lease(jobs, ids(spark, 1, 1, 2), "w1", NOW, 600)
    assert state(longer, 1)[4] == datetime(2024, 1, 10, 0, 10) and state(longer, 2)[4] == LATER
    assert state(queue.extend_lease(jobs, ids(spark, 1), "other:1", NOW, 600), 1)[4] == LEASE
    done = queue.complete(jobs, ids(spark, 1))
    assert state(queue.extend_lease(done, ids(spark, 1), "w1", NOW, 600), 1)[4] == LEASE


def test_only_running_jobs_complete_or_fail(spark):
    jobs = jobs_of(spark, (1, "ingest", "queued", 1, 0, PAST, None, None), (2, "ingest", "running", 1, 0, PAST, "w0", LATER), (3, "ingest", "running", 1, 4, PAST, "w0", LATER), (4, "ingest", "running", 1, 0, PAST, "w0", LATER))
    assert rows(queue.complete(jobs, ids(spark, 1, 2, 2)), "job_id", "status") == [(1, "queued"), (2, "done"), (3, "running"), (4, "running")]
    told = spark.createDataFrame([(1, True), (2, False), (2, False), (3, False), (4, True), (4, None)], "job_id long, permanent boolean")
    failed = queue.fail(jobs, told, NOW)
    assert state(failed, 1) == ("queued", 0, PAST, None, None)
    assert state(failed, 2) == ("failed", 1, datetime(2024, 1, 10, 0, 0, 30), None, None)
    assert state(failed, 3) == ("dead", 5, PAST, None, None) and state(failed, 4) == ("dead", 1, PAST, None, None)


def test_crashed_workers_jobs_are_claimed_again_without_an_attempt(spark):
    jobs = jobs_of(spark, (1, "ingest", "running", 1, 2, PAST, "w0", PAST), (2, "ingest", "running", 1, 0, PAST, "w0", LATER), (3, "ingest", "running", 1, 0, PAST, "w1", None), (4, "ingest", "dead", 1, 5, PAST, "w0", PAST))
    reaped = queue.reap(jobs, NOW)
    assert state(reaped, 1) == ("failed", 2, AT, None, None) and state(reaped, 2)[0] == state(reaped, 3)[0] == "running" and state(reaped, 4)[0] == "dead"
    assert rows(queue.reap(jobs_of(spark, *[(k, "x", "running", 1, 0, PAST, "w", datetime(2024, 1, 1, k)) for k in range(5)]), NOW, 2).where("status = 'failed'"), "job_id") == [(0,), (1,)]
    assert rows(queue.claim(reaped, NOW, 5, "w2", 60).where("locked_by = 'w2'"), "job_id", "attempts") == [(1, 2)]
    swept = queue.orphan_sweep(jobs, NOW, "w1")
    assert rows(swept, "job_id", "status", "locked_by") == [(1, "failed", None), (2, "failed", None), (3, "running", "w1"), (4, "dead", "w0")]
    assert state(queue.requeue_crashed(jobs, ids(spark, 1, 4), NOW), 4)[0] == "dead"


def test_a_retry_restarts_the_latest_ingest_job_and_its_document(spark):
    jobs = jobs_of(spark, (10, "ingest", "dead", 1, 5, PAST, None, None), (11, "ingest", "dead", 1, 5, LATER, "w", PAST), (12, "export", "done", 1, 0, PAST, None, None), (20, "ingest", "done", 1, 0, PAST, None, None), (30, "export", "dead", 1, 5, PAST, None, None))
    asked = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 3), (2, 1)], "tenant_id long, document_id long")
    assert rows(queue.retry_outcomes(jobs, asked).fillna(0), "tenant_id", "document_id", "job_id", "outcome") == [(1, 1, 11, "requeued"), (1, 2, 20, "not retryable"), (1, 3, 0, "no job"), (2, 1, 0, "no job")]
    after = queue.retry(jobs, asked, NOW)
    assert state(after, 11) == ("queued", 0, AT, None, None) and state(after, 10)[0] == "dead" and state(after, 30)[0] == "dead"
    docs = spark.createDataFrame([(1, 1, "failed"), (1, 2, "failed"), (2, 1, "failed")], "tenant_id long, document_id long, status string")
    files = spark.createDataFrame([(1, 1, 7, "failed"), (1, 1, 8, "ready"), (2, 1, 9, "failed")], "tenant_id long, document_id long, file_id long, status string")
    new_docs, new_files = queue.retried(jobs, asked, docs, files)
    assert rows(new_docs, "tenant_id", "document_id", "status") == [(1, 1, "pending"), (1, 2, "failed"), (2, 1, "failed")]
    assert rows(new_files, "file_id", "status") == [(7, "pending"), (8, "ready"), (9, "failed")]
    assert rows(queue.dead_letters(jobs, docs.replace("failed", "pending")), "tenant_id", "document_id", "status") == [(1, 1, "failed"), (1, 2, "pending"), (2, 1, "pending")]
    assert rows(queue.dead_letter_files(jobs, files.replace("failed", "pending")), "file_id", "status") == [(7, "failed"), (8, "ready"), (9, "pending")]


def test_pages_are_merged_in_order(spark):
    pages = spark.createDataFrame([(1, 2, None, "two"), (1, 1, "front", "one"), (1, 3, None, None)], "document_id long, page_no int, label string, text string")
    assert chunking.merge_pages(pages).first().text == "--- page 1 (front) ---\none\n\n--- page 2 ---\ntwo\n\n--- page 3 ---"
    meta = spark.createDataFrame([(1, 2, None, {"a": "3"}), (1, 1, {"a": "1", "b": "2"}, {"a": "9"})], "document_id long, page_no int, extracted map<string,string>, own map<string,string>")
    told = chunking.merge_meta(meta).select(F.from_json("meta", "map<string,map<string,string>>").alias("m")).first().m
    assert told == {"page_1": {"a": "9", "b": "2"}, "page_2": {"a": "3"}}
    there = spark.createDataFrame([(1, 4), (1, 2)], "document_id long, page_no int")
    added = spark.createDataFrame([(1, 20), (1, 10), (2, 5)], "document_id long, position int")
    assert rows(chunking.next_page_numbers(there, added), "document_id", "position", "page_no") == [(1, 10, 5), (1, 20, 6), (2, 5, 1)]


def test_requests(spark):
    asked = spark.createDataFrame([(1, " q ", "code, nothing", "a,,b ", "500"), (2, None, None, None, "x")], "query_id long, q string, kinds string, tags string, limit_text string")
    got = rows(search.parse_filters(asked, ("code", "image")), "query_id", "q", "kind_list", "tag_list", "top_k", "unknown_kinds")
    assert got == [(1, "q", ["code", "nothing"], ["a", "b"], 100, ["nothing"]), (2, None, [], [], 10, [])]
    hits = spark.createDataFrame([(1, 1), (1, 2), (1, 12)], "query_id long, rank int")
    assert rows(search.cited(spark.createDataFrame([(1, "see [2] and [12]")], "query_id long, answer string"), hits), "rank") == [(2,), (12,)]
    seen = []

    def embed(texts):
        seen.extend(r.text for r in texts.collect())
        return texts.withColumn("embedding", F.array(F.length("text").cast("double")))

    queries = spark.createDataFrame([(1, " A b"), (2, "a B "), (3, "c")], "query_id long, text string")
    assert rows(search.embed_once(queries, embed), "query_id", "embedding") == [(1, [3.0]), (2, [3.0]), (3, [1.0])] and sorted(seen) == ["a b", "c"]


def test_nearest_tags_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tagging, "TILE", 16)  # several cells a tenant
    rng = np.random.default_rng(3)
    names = [(i % 3, i, rng.normal(size=4 if i % 10 else 3).tolist()) for i in range(150)] + [(0, 900, [0.0] * 4), (0, 901, None), (7, 902, [1.0] * 4)]
    tags = [(i % 3, i, rng.normal(size=4 if i % 9 else 3).tolist()) for i in range(70)] + [(0, 71, [0.0] * 4)]
    tags += [(t, 1000 + i, v) for t, i, v in tags[:20]]  # equal vectors: the smaller id wins
    got = {r.name_id: (r.tag_id, round(r.similarity, 9)) for r in tagging.nearest(spark.createDataFrame(names, "tenant_id long, name_id long, embedding array<double>"), spark.createDataFrame(tags, "tenant_id long, tag_id long, embedding array<double>"), 0.5).collect()}
    want = {}
    for t, i, v in names:
        found = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), k) for u, k, w in tags if u == t and v and len(v) == len(w) and np.linalg.norm(v) and np.linalg.norm(w)]
        if found and -min(found)[0] >= 0.5:
            want[i] = (min(found)[1], -min(found)[0])
    assert got == want
