import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import search, tagging
from siftwell.operators.keyword_index import Index
from siftwell.operators.vector_index import Model, VectorIndex
from siftwell.sources.snapshots import Conflict

WORDS = [f"w{k}" for k in range(40)]


def chunk_rows(rng, ids):
    """Chunks in which a word is the rarer the higher its number."""
    return [(k // 3, k, " ".join(rng.choice(WORDS[: rng.choice((3, 10, 40))]) for _ in range(rng.randrange(0, 30))) or None) for k in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "document_id long, chunk_id long, content string")


def ask(spark):
    return spark.createDataFrame([(1, "w1 W39 w5"), (2, "w30 'w31'"), (3, " "), (4, "w0 w1 w2 w0"), (5, "nothing known"), (6, "w38")], "query_id long, text string")


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.document_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr("siftwell.operators.keyword_index.SLOT_CHUNKS", 16)
    monkeypatch.setattr("siftwell.operators.keyword_index.SEED_SLOTS", 2)
    monkeypatch.setattr("siftwell.operators.keyword_index.PARTS", 4)


def test_an_index_kept_up_is_like_a_fresh_one(spark, tmp_path, small):
    rng = random.Random(1)
    index, queries = Index(spark, str(tmp_path / "i")), ask(spark)
    assert hits(index.search(queries, 5)) == []
    now = {}

    def same(*limits):
        flat = search.postings(frame(spark, list(now.values())))
        for limit in limits:
            assert hits(index.search(queries, limit)) == hits(search.bm25(flat, queries, limit))

    def put(rows, gone=()):
        now.update({r[1]: r for r in rows})
        for k in gone:
            now.pop(k, None)

    first = chunk_rows(rng, range(300))
    assert index.update(frame(spark, first), writer="w", batch=0) == 1
    put(first)
    same(3, None)
    assert index.update(frame(spark, first), writer="w", batch=0) == 1  # repeated
    again = [(r[0], r[1], "w39 w39 w1") for r in first[:5]] + chunk_rows(rng, range(500, 560))  # new contents and new chunks
    index.update(frame(spark, again), spark.createDataFrame([(k,) for k in (10, 11, 12, 999)], "chunk_id long"), writer="w", batch=1)
    put(again, (10, 11, 12))
    same(1, 7, 1000)
    index.update(remove=spark.createDataFrame([(k,) for k in (0, 500, 501)], "chunk_id long"))
    put([], (0, 500, 501))
    index.update(frame(spark, [(0, 10, "w38 back again")]))  # one that was removed
    put([(0, 10, "w38 back again")])
    same(4, None)
    stale = index.store.begin()
    index.merge()
    same(4, None)
    stale.replace("stats", stale.read("stats"))
    with pytest.raises(Conflict):
        stale.commit()
    assert index.store.begin().read("gone").count() == 0 and index.store.begin().read("stats").count() == 1
    assert hits(search.bm25(index.postings(), queries, 4)) == hits(index.search(queries, 4))
    index.update(remove=frame(spark, list(now.values())).select("chunk_id"))
    assert hits(index.search(queries, 5)) == []


def test_upkeep_merges_many_segments(spark, tmp_path, small, monkeypatch):
    monkeypatch.setattr("siftwell.operators.keyword_index.MERGE_AT", 3)
    index, rng, rows = Index(spark, str(tmp_path / "i")), random.Random(2), []
    told = []
    for k in range(3):
        rows += chunk_rows(rng, range(20 * k, 20 * k + 20))
        index.update(frame(spark, rows[-20:]))
        told.append(index.upkeep())
    assert told == [False, False, True]
    assert hits(index.search(ask(spark), 5)) == hits(search.bm25(search.postings(frame(spark, rows)), ask(spark), 5))


def test_fewer_slots_are_read_for_fewer_hits_and_parts_are_pruned(spark, tmp_path, small):
    rng = random.Random(3)
    rows = chunk_rows(rng, range(1200)) + [(5000 + k, 5000 + k, "w0 " * (20 + k) + "rare") for k in range(4)]
    index = Index(spark, str(tmp_path / "i"))
    index.update(frame(spark, rows))
    queries = spark.createDataFrame([(1, "rare w0"), (2, "w0 w7")], "query_id long, text string")
    read = [index.slots(queries, k).count() for k in (1, 5, 2000)]
    assert read[0] < read[1] < read[2]
    assert hits(index.search(queries, 3)) == hits(search.bm25(search.postings(frame(spark, rows)), queries, 3))
    _, blocks, _, _ = index._weights(index.store.begin(), spark.createDataFrame([(1, "rare")], "query_id long, text string"))
    plan = blocks._jdf.queryExecution().toString()
    assert "In(term, [rare])" in plan or "EqualTo(term,rare)" in plan.replace(" ", "")
    assert len({f.split("__part=")[1].split("/")[0] for f in blocks.inputFiles()}) == 1


def test_a_scan_for_many_queries_finds_what_the_join_finds(spark, tmp_path, small, monkeypatch):
    rng = random.Random(4)
    rows = chunk_rows(rng, range(900)) + [(3000 + k, 3000 + k, "w0 w1 w2") for k in range(50)]  # the last ones tie
    index = Index(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame([(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6)))) for k in range(120)], "query_id long, text string")
    monkeypatch.setattr(search, "SCAN_POSTINGS", 500)
    monkeypatch.setattr(search, "SCAN_CELLS", 2_000)
    index.update(frame(spark, rows))
    assert index.store._names("_work") == []
    flat, live = search.postings(frame(spark, rows)), [r for r in rows if r[1] % 7]
    for passes in (4_000_000, 300):
        monkeypatch.setattr(search, "PASS_ROWS", passes)
        assert hits(index.search(queries, 7)) == [h for h in hits(search.bm25(flat, queries)) if h[1] <= 7]
    assert hits(search.bm25(flat, queries, 7)) == hits(index.search(queries, 7))
    assert "Join" not in index.search(queries, 7)._jdf.queryExecution().optimizedPlan().toString().replace("LeftSemi", "")
    index.update(remove=frame(spark, rows).where("chunk_id % 7 = 0").select("chunk_id"))
    for limit in (1, 60):
        assert hits(index.search(queries, limit)) == [h for h in hits(search.bm25(search.postings(frame(spark, live)), queries)) if h[1] <= limit]


def records_shuffled(spark, run, told="shuffleWriteRecords"):
    """Rows, or bytes, that the stages of run wrote to shuffles."""
    sc = spark.sparkContext
    jvm, gateway = sc._jvm, sc._gateway

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): getattr(s, told)() for s in map(stages.apply, range(stages.size()))}

    before = total()
    run()
    return sum(n for stage, n in total().items() if stage not in before)


def test_postings_are_written_without_being_rows(spark, tmp_path):
    """A posting is a place in a block from the task on that has its chunk; only blocks and ids are shuffled. Before, every posting was a row, and every chunk's text too."""
    rng = random.Random(6)
    rows = [(k // 3, k, " ".join(rng.sample(WORDS, 30))) for k in range(600)]
    index = Index(spark, str(tmp_path / "i"))
    assert records_shuffled(spark, lambda: index.update(frame(spark, rows))) < 30 * 600 / 4
    t = index.store.begin()
    assert t.read("blocks").agg(F.sum("n")).first()[0] == 30 * 600 and t.read("stats").first().asDict() == {"segment": 1, "n": 600, "words": 18_000}


def test_a_removal_writes_places_and_no_terms(spark, tmp_path):
    rows = [(k // 3, k, " ".join(WORDS[k % 10 : k % 10 + 30]) + " a" * (300 * (k == 5))) for k in range(600)]
    index, gone = Index(spark, str(tmp_path / "i")), spark.range(0, 600, 3).toDF("chunk_id")
    index.update(frame(spark, rows))
    assert records_shuffled(spark, lambda: index.update(remove=gone)) < 30 * 200 / 2  # before: a row for each chunk and term
    queries = spark.createDataFrame([(k, f"w{k} a") for k in range(40)], "query_id long, text string")
    live = search.postings(frame(spark, [r for r in rows if r[1] % 3]))
    for asked in (queries, queries.where("query_id < 3")):  # by a scan, by slots
        assert hits(index.search(asked, 4)) == [h for h in hits(search.bm25(live, asked)) if h[1] <= 4]


def test_a_scan_shuffles_few_bytes_for_a_posting(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k // 3, k, " ".join(rng.sample(WORDS, 20))) for k in range(6000)]
    index = Index(spark, str(tmp_path / "i"))
    index.update(frame(spark, rows))
    queries = spark.createDataFrame([(k, WORDS[k]) for k in range(40)], "query_id long, text string")
    found = []
    sent = records_shuffled(spark, lambda: found.extend(hits(index.search(queries, 2))), "shuffleWriteBytes")
    assert len(found) == 80 and sent < 4 * 20 * 6000  # before: each with the ids of its chunk and document, its count and length


def test_one_row_of_an_id_is_taken(spark, tmp_path, small):
    rows = chunk_rows(random.Random(7), range(90))
    index = Index(spark, str(tmp_path / "i"))
    index.update(frame(spark, rows + rows[:40] + rows[30:35]).repartition(3))
    assert hits(index.search(ask(spark), 9)) == hits(search.bm25(search.postings(frame(spark, rows)), ask(spark), 9))
    assert index.postings().where("term = ''").count() == 90


def vectors_of(spark, x, extra=()):
    return spark.createDataFrame([(k // 5, k, v.tolist()) for k, v in enumerate(x)] + list(extra), "document_id long, chunk_id long, embedding array<double>")


def recall(exact, found):
    want, got = ({(r.query_id, r.chunk_id) for r in df.collect()} for df in (exact, found))
    return len(want & got) / len(want)


def test_codes_estimate_similarities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = Model.fit(x, 8)
    cell, codes = model.encode(x)
    rows = np.flatnonzero(cell == 3)
    assert np.abs(model.estimates(x[:20], 3, codes[rows]) - x[:20] @ x[rows].T).mean() < 0.06


def test_vector_index_against_the_exact_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("siftwell.operators.vector_index.CELL_ROWS", 100)  # a hot cell is sliced
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 24)), np.repeat(centres[:1], 450, 0)])  # a third of all are the same
    odd = [(9, 90_000, [0.0] * 24), (9, 90_001, None), (9, 90_002, [1.0] * 5), (9, 90_003, [])]
    rows = vectors_of(spark, x, odd)
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(rows, cells=16, sample_rows=700)
    assert index.store.read("vectors").count() == 1350 == index.store.read("codes").count()
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 900, 30)] + [(7000, [0.0] * 24), (7001, None), (7002, [1.0])], "query_id long, embedding array<double>")
    exact = search.vector_arm(rows, queries, 10)
    assert 1 <= index.store.begin().read("probes").first().probes <= 8
    assert recall(exact, index.search(queries, 10)) >= 0.9
    assert hits(index.search(queries, 10, probes=16, depth=2000)) == hits(exact)  # all cells, all candidates
    index.add(spark.createDataFrame([(1, 80_000, x[30].tolist())], "document_id long, chunk_id long, embedding array<double>"))
    assert (30, 80_000) in {(r.query_id, r.chunk_id) for r in index.search(queries, 10, probes=4).collect()}
    one = index.store.begin()
    assert len(one.read("codes", [3]).inputFiles()) < len(one.read("codes").inputFiles())


def test_tiles_and_blocks_lose_no_row(spark, tmp_path, monkeypatch):
    """Small tiles, sliced cells and blocks of few queries give what the exact scan gives, and a tile hands on no more than the limit for a query."""
    monkeypatch.setattr("siftwell.operators.vector_index.TILE_ROWS", 60)
    monkeypatch.setattr("siftwell.operators.vector_index.FOUND_ROWS", 100)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 150, 0)])
    rows = vectors_of(spark, x, [])
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(rows, cells=9, sample_rows=400)
    t = index.store.begin()
    assert max(n for _, _, n in index._tiles(t, 60)) >= 3 and len({first for _, first, _ in index._tiles(t, 60)}) >= 4
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 450, 9)], "query_id long, embedding array<double>")
    want = hits(search.vector_arm(rows, queries, 10))
    handed = []
    monkeypatch.setattr("siftwell.operators.vector_index.top", lambda met, *a: (handed.append(met.count()), search.top(met, *a))[1])
    assert hits(index.search(queries, 10, probes=1 << 30, depth=1 << 30)) == want
    assert handed[0] <= 10 * 50 * 20  # before: every row for every query
    assert hits(index.search(queries, 10, probes=1 << 30, depth=440)) == want  # by codes


def test_best_rows_of_many_batches(monkeypatch):
    monkeypatch.setattr(search, "SIM_CELLS", 70)
    monkeypatch.setattr(search, "NEW_ROWS", 30)
    rng = np.random.default_rng(5)
    q, x = rng.integers(-2, 3, (7, 3)) + 0.5, rng.integers(-2, 3, (400, 3)) + 0.5  # many ties
    q, x = q / np.linalg.norm(q, axis=1)[:, None], x / np.linalg.norm(x, axis=1)[:, None]
    ids, best = rng.permutation(400), search.Best(7, 12)
    for at in range(0, 400, 33):
        best.offer(np.arange(7), q, x[at : at + 33], ids[at : at + 33], ids[at : at + 33])
        assert len(best.held[0]) <= 7 * 12
    query, score, chunk, document = best.settle()
    sims = np.round(q @ x.T, 9)
    for k in range(7):
        want = ids[np.lexsort((ids, -sims[k]))[:12]]
        assert chunk[query == k].tolist() == document[query == k].tolist() == want.tolist()


def test_recall_on_the_test_table(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.floor(F.col("vec_id") / 5).alias("document_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(e)
    queries = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert recall(search.vector_arm(e, queries, 10), index.search(queries, 10)) >= 0.9


def walk(names, tags, threshold):
    """Names one by one, as their order says."""
    known, units, out = {}, {}, []
    for t, name, v in sorted(tags, key=lambda x: (x[0], x[1])):
        known[t, name] = name
        units.setdefault(t, []).append((name, v))
    for t, seq, name, v in sorted(names, key=lambda x: (x[0], x[1], x[2])):
        tag, new = known.get((t, name)), False
        if tag is None:
            sims = [(-round(float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)), 9), i) for i, (_, u) in enumerate(units.get(t, [])) if v and u and len(u) == len(v) and np.linalg.norm(u) and np.linalg.norm(v)]
            tag = units[t][min(sims)[1]][0] if sims and -min(sims)[0] >= threshold else None
            new = tag is None
            tag = name if new else tag
            if new:
                units.setdefault(t, []).append((name, v))
            known[t, name] = tag
        out.append((t, seq, name, tag, new))
    return sorted(out)


@pytest.mark.parametrize("block", [3, 40, 1000])
def test_canonical_names_against_the_walk(spark, monkeypatch, block):
    monkeypatch.setattr(tagging, "BLOCK", block)
    monkeypatch.setattr(tagging, "TILE", 50)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(30, 5))
    names, tags = [], []
    for k in range(300):
        tenant = int(rng.choice([0, 0, 0, 1, 2]))
        near = centres[rng.integers(0, 30)] + 0.5 * rng.normal(size=5)
        names.append((tenant, int(rng.integers(0, 10_000)), f"n{rng.integers(0, 250)}", near.tolist()))
    names += [(0, 5, "zero", [0.0] * 5), (0, 6, "zero", [0.0] * 5), (0, 7, "none", None), (1, 8, "short", [1.0, 0.0]), (1, 9, "short too", [1.0, 0.1]), (3, 1, "alone", [1.0] * 5), (0, 3, "g1", centres[0].tolist())]
    tags += [(t, f"g{k}", centres[k].tolist()) for t in (0, 1) for k in range(8)]
    got = tagging.canonicalize(spark.createDataFrame(names, "tenant_id long, seq long, name string, embedding array<double>"), spark.createDataFrame(tags, "tenant_id long, name string, embedding array<double>"), 0.8)
    assert sorted(tuple(r) for r in got.collect()) == walk(names, tags, 0.8)
