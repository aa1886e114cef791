import gzip
import io
import math
import random
import tarfile
import zipfile
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import files, markup, notes, quota, schedule, tags, text, vectors
from siftwell.operators import chunking, lifecycle, limits, search, tagging
from siftwell.plans import fixtures
from siftwell.sources import catalog, uploads
from siftwell.streaming import job_stream, usage_stream


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_chunks_of_ascii_and_multibyte(spark):
    rows = [(1, "a" * 30), (2, "é" * 20), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "document_id long, text string").selectExpr("document_id", "document_id as file_id", "1 as page_no", "text")
    found = defaultdict(list)
    for r in chunking.chunk(df, 12, 4).collect():
        found[r.document_id].append((r.idx, r.start, r.content))
    assert [s for _, s, _ in sorted(found[1])] == [0, 8, 16, 24]
    assert "".join(c for _, s, c in sorted(found[2]))[:6] == "é" * 6 and 3 not in found and 4 not in found


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.integers(5, 40))
def test_spans_cover_whole_characters(body, size):
    data = body.encode()
    spans = text.spans(data, size, 4)
    for a, b in spans:
        data[a:b].decode()
    if data:
        assert spans[0][0] == 0 and spans[-1][1] == len(data)


def test_uniform_chunks_fold(spark):
    df = spark.createDataFrame([(1, 1, 1, "x" * 5500)], "document_id long, file_id long, page_no int, text string")
    assert chunking.drop_identical(chunking.chunk(df, 1000, 0)).count() == 2


def test_truncation(spark):
    assert value(spark, text.truncate_bytes(F.lit("aé漢"), 4)) == "aé"
    assert value(spark, text.truncate_words(F.lit("one two three"), 8)) == "one two…" or value(spark, text.truncate_words(F.lit("one two three"), 8)) == "one…"
    assert value(spark, text.token_cost_milli(F.lit("ab !é"))) == 250 * 3 + 1000 + 2000
    assert value(spark, text.truncate_tokens(F.lit("abcdefgh"), 1)) == "abcd"


def test_texts_are_cut_in_place(spark):
    """Long texts reach Python in part, with the results for whole ones; the first and last lengths stand on both sides of that bound."""

    def shrunk(t, attempt):
        for _ in range(attempt if t else 0):
            target, used = max(1, sum(map(text._cost, t)) // 1000 // 2), 0
            for i, c in enumerate(t):
                used += text._cost(c)
                if used // 1000 >= target:
                    t = t[:i]
                    break
        return t

    def prefix(t, tokens):
        left = tokens * 1000
        for i, c in enumerate(t):
            left -= text._cost(c)
            if left < 0:
                return t[:i]
        return t

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n!é漢\U0001f600") if k % 3 else "x" for k in range(n)) for n in (0, 1, 3, 900, 1185, 1186, 1187, 9000)] + ["a\n\n" * 700, "é" * 245_000 + "a" * 4000, "x" + "漢" * 170_000]
    whole = text.bound_head_and_tail
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "id long, t string")
    got = rows.select("id", text.truncate_tokens(F.col("t"), 20).alias("a"), text.bound_text(F.col("t"), 20).alias("b"), *[text.shrink_for_context(F.col("t"), k).alias(f"s{k}") for k in (0, 1, 3)]).orderBy("id").collect()
    for r, t in zip(got, texts, strict=False):
        assert (r.a, r.b) == (prefix(t, 20), whole(t, 20)) and [r.s0, r.s1, r.s3] == [shrunk(t, k) for k in (0, 1, 3)]
    assert list(got[-1])[1:] == [None] * 5


def test_keywords_are_counted_in_their_rows(spark, monkeypatch):
    rows = [(1, "Wolf wolf bear lynx the"), (2, "wolf bear bear"), (2, "bear hare HARE hare"), (None, "moose"), (None, "moose deer"), (3, ""), (4, None), (5, "wolf otter")]
    docs = spark.createDataFrame(rows, "document_id long, text string")
    want = {1: ["lynx", "wolf"], 2: ["hare", "bear"], None: ["moose", "deer"], 5: ["otter", "wolf"]}
    for most in (1_000_000, 0):
        monkeypatch.setattr(tagging, "TERMS_BROADCAST", most)
        assert {r.document_id: r.tags for r in tagging.keywords(docs, 2).collect()} == want
    monkeypatch.setattr(tagging, "TERMS_BROADCAST", 1_000_000)
    plan = tagging.keywords(docs.where("document_id = 1"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("hashpartitioning") == 1  # before: all words of all documents were dealt out three times


def test_highlight_escapes_first(spark):
    assert value(spark, text.highlight(F.lit("a <b> & Word"), F.lit("word"))) == "a &lt;b&gt; &amp; <mark>Word</mark>"


def test_html_csv_markdown(spark):
    assert value(spark, markup.strip_html(F.lit("<p>a &amp;lt; b</p><br/>c<script>x()</script>"))) == "a &lt; b\ncx()"
    assert value(spark, markup.csv_to_text(F.lit('a,"b ""c"", d"\r\ne,f\r\n'))) == 'a b "c", d\ne f'
    assert value(spark, markup.strip_markdown(F.lit("# T\n**b** [l](u) snake_case\n---\n> q"))) == "T\nb l snake_case\nq"


def test_mime_and_hosts(spark):
    assert value(spark, files.detect_mime(F.lit(b"%PDF-1.4"))) == "application/pdf"
    assert value(spark, files.detect_mime(F.lit(b""))) == "application/x-empty"
    for host, blocked in (("10.0.0.1", True), ("8.8.8.8", False), ("localhost", True), ("a.internal", True), ("example.org", False), ("172.20.1.1", True)):
        assert value(spark, files.blocked_host(F.lit(host))) is blocked


def test_tags_and_notes(spark):
    assert value(spark, tags.normalize(F.lit("Machine-Learning/Running_boxes"))) == "machine learn run boxe"
    assert value(spark, notes.due_date(F.lit("friday"), F.lit("2024-02-02").cast("date"))) == "2024-02-09"
    assert value(spark, notes.due_date(F.lit("in 3 days"), F.lit("2024-02-02").cast("date"))) == "2024-02-05"


def test_quota_and_schedule(spark):
    assert value(spark, quota.usage_level(F.lit(80), F.lit(100))) == "warn"
    assert value(spark, quota.exceeds(F.lit(2**63 - 1), F.lit(2**63 - 1), F.lit(1))) is True
    assert value(spark, schedule.backoff_seconds(F.lit(3))) == 120
    assert value(spark, schedule.refetch_backoff(F.lit(10), 60, 3600)) is None


def test_attractor_corpus_fills_with_documents(spark):
    unit = [1.0] + [0.0] * 19
    rows = [(1, i, unit) for i in range(100)]
    for i in range(5):
        v = [0.9] + [0.0] * 19
        v[10 + i] = math.sqrt(1 - 0.81)
        rows.append((10 + i, 1000 + i, v))
    hits = search.one_per_document(search.vector_arm(spark.createDataFrame(rows, "document_id long, chunk_id long, embedding array<float>"), spark.createDataFrame([(1, unit)], "query_id long, embedding array<float>"), search.overscan(5)), 5)
    assert [r.document_id for r in hits.orderBy("rank").collect()] == [1, 10, 11, 12, 13]


def test_vectors_of_odd_shape(spark):
    assert value(spark, vectors.cosine_similarity(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) is None
    assert value(spark, vectors.cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_limits_against_loops(spark):
    start = datetime(2024, 1, 1)
    events = [(f"k{i % 3}", start + timedelta(seconds=(i * 37) % 500), i, 1.0 + i % 2, i % 4 != 0) for i in range(200)]
    df = spark.createDataFrame(events, "key string, ts timestamp, event_id long, cost double, ok boolean")
    got = {r.event_id: r.allowed for r in limits.sliding_log(df, 5, 60).collect()}
    want, logs = {}, defaultdict(deque)
    for k, ts, i, *_ in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        log = logs[k]
        while log and (ts - log[0]).total_seconds() >= 60:
            log.popleft()
        want[i] = len(log) < 5
        if want[i]:
            log.append(ts)
    assert got == want
    assert limits.token_bucket(df, 3, 0.01).where("left < 0 or left > 3").count() == 0
    assert {r.state for r in limits.circuit_breaker(df, 1, 30).collect()} == {"open", "closed"}


def test_canonicalize_walks_in_order(spark):
    names = spark.createDataFrame([(1, 1, "a", [1.0, 0.0]), (1, 2, "b", [0.99, 0.1]), (1, 3, "c", [0.0, 1.0]), (2, 1, "b", [1.0, 0.0])], "tenant_id long, seq long, name string, embedding array<double>")
    got = {(r.tenant_id, r.seq): (r.tag, r.is_new) for r in tagging.canonicalize(names, names.limit(0).select("tenant_id", "name", "embedding")).collect()}
    assert got == {(1, 1): ("a", True), (1, 2): ("a", False), (1, 3): ("c", True), (2, 1): ("b", True)}


def test_archives_and_mail(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
        f.writestr("../evil.txt", "no")
        f.writestr("b.bin", b"\x00\x01")
    with tarfile.open(fileobj=t, mode="w") as f:
        info = tarfile.TarInfo("c.txt")
        info.size = 5
        f.addfile(info, io.BytesIO(b"world"))
    df = spark.createDataFrame([(1, z.getvalue()), (2, gzip.compress(t.getvalue())), (3, b"PK\x03\x04broken"), (4, None)], "file_id long, content binary")
    found = uploads.harvest(df)
    assert {(r.file_id, r.name, r.text) for r in found.collect()} == {(1, "a.txt", "hello"), (2, "c.txt", "world")}
    assert uploads.archive_text(found).where("file_id = 1").first().text == "\n--- a.txt ---\nhello\n"
    mail = b"From: a@b.c\r\nSubject: s\r\nContent-Type: text/plain\r\n\r\nbody\r\n"
    row = uploads.with_email(spark.createDataFrame([(mail,)], "content binary")).first()
    assert row.meta["email:subject"] == "s" and row.text.strip() == "body"


def test_tenant_catalog(spark):
    docs = spark.createDataFrame([(1, 7), (2, 8)], "document_id long, tenant_id long")
    relations = {"documents": docs, "tags": spark.createDataFrame([(1, "x"), (2, "y")], "document_id long, name string")}
    assert [r.name for r in catalog.TenantCatalog(relations, 8)["tags"].collect()] == ["y"]
    assert catalog.TenantCatalog(relations, None)["documents"].count() == 0


def test_stream_of_jobs_matches_fold(spark, tmp_path):
    events = [(j, s, e, float(s)) for j in range(3) for s, e in enumerate(["enqueue", "claim", "fail", "retry", "claim", "complete"])]
    spark.createDataFrame(events, "job_id long, seq long, event string, at double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, seq long, event string, at double").parquet(str(tmp_path / "in"))
    query = job_stream.job_states(stream).writeStream.format("memory").queryName("job_states").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    last = spark.sql("SELECT status, attempts FROM job_states WHERE seq = 5").collect()
    assert [(r.status, r.attempts) for r in last] == [("done", 0)] * 3


def test_roll_up_stream_matches_batch(spark, tmp_path):
    from siftwell.operators import usage

    schema = "tenant_id long, prompt_tokens long, completion_tokens long, created_at timestamp_ntz"
    rows = [(i % 2, i, None, datetime(2024, 1 + i % 3, 1)) for i in range(30)]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    usage_stream.start_roll_up(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, usage_stream.stored_roll_up(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, usage.roll_up(df).collect()))


def test_empty_corpus(spark):
    chunks = spark.createDataFrame([], "document_id long, chunk_id long, content string")
    assert search.bm25(search.postings(chunks), spark.createDataFrame([(1, "a")], "query_id long, text string"), 5).count() == 0


@pytest.mark.parametrize("job, event, want", [(("queued", 0, 5.0), "claim", "queued"), (("running", 4, 0.0), "fail", "dead"), (("dead", 5, 0.0), "retry", "queued"), (("done", 0, 0.0), "fail", "done")])
def test_job_transitions(job, event, want):
    assert job_stream.advance(*job, event, 1.0)[0] == want


def test_vector_ids_are_whole_numbers(spark):
    rows = spark.createDataFrame([(2**62 + 1, 9007199254740993, [1.0, 0.0])], "document_id long, chunk_id long, embedding array<double>")
    (hit,) = search.vector_arm(rows, spark.createDataFrame([(1, [1.0, 0.5])], "query_id long, embedding array<double>"), 3).collect()
    assert (hit.document_id, hit.chunk_id) == (2**62 + 1, 9007199254740993)


def test_path_classes(spark):
    paths = ["a.md", "docs/a.md", "x/hr/a.md", "hr", "docs/", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.c for r in df.select(notes.path_class(F.col("path"), ("hr",)).alias("c")).collect()] == ["internal", "public", "confidential", "confidential", "internal", None]


def test_shred_leaves_what_is_not_the_tenants(spark):
    docs = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "document_id long, tenant_id long")
    left = lifecycle.shred({"documents": docs, "pages": docs.select("document_id"), "plans": docs.select(F.col("document_id").alias("plan_id"))}, 1)
    assert {n: df.count() for n, df in left.items()} == {"documents": 2, "pages": 2, "plans": 3}


def test_long_csv_cells_and_unknown_charsets():
    assert markup.csv_text('a,"' + "b" * 200_000 + '"') == "a " + "b" * 200_000
    told = uploads.parse_email(b"Subject: x\nContent-Type: text/plain; charset=no-such-set\n\nbody caf\xc3\xa9\n")
    assert told["plain"].strip() == "body café"


def test_texts_stay_where_they_are_in_the_search_for_items(spark, sf):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixtures.expected(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "hashpartitioning(doc_id" not in plan  # before: all documents with their texts were dealt out by id
