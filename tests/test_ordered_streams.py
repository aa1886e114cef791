import random
from datetime import datetime, timedelta

import pytest

from siftwell.operators import limits
from siftwell.streaming import ordered

START = datetime(2024, 1, 1)
EVENT = "key string, ts timestamp, event_id long, cost double, ok boolean"
JOB_EVENT = "job_id long, ts timestamp, event_id long, event string, worker string"


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def run(spark, tmp_path, schema, files, made, runs=2):
    """Rows that a stream tells, one micro-batch for each file. It is stopped and started anew between its runs."""
    source, out = tmp_path / "in", tmp_path / "out"
    for k in range(runs):
        for n, rows in list(enumerate(files))[k::runs] if runs == 1 else list(enumerate(files))[k * len(files) // runs : (k + 1) * len(files) // runs]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"part{n:03d}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
        query = made(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(150)
    return spark.read.parquet(str(out)).collect(), query.lastProgress


def dealt(rng, events, parts):
    """Events of at most some minutes' disorder, cut into micro-batches."""
    mixed = sorted(events, key=lambda e: (e[1] + timedelta(seconds=rng.uniform(0, 240)), e[2]))
    return [mixed[k * len(mixed) // parts : (k + 1) * len(mixed) // parts] for k in range(parts)]


@pytest.mark.parametrize("name", ["sliding_log", "token_bucket", "circuit_breaker"])
def test_streams_tell_what_batches_tell(spark, tmp_path, name):
    rng = random.Random(name)
    events = [(f"k{rng.randrange(4)}", START + timedelta(seconds=rng.randrange(3000), microseconds=rng.randrange(3) * 250), k, float(rng.randrange(1, 4)), rng.random() < 0.6) for k in range(240)]
    args = {"sliding_log": (4, 120.0), "token_bucket": (6.0, 0.05), "circuit_breaker": (2, 100.0)}[name]
    end = [("end", START + timedelta(days=1 + k), 1000 + k, 1.0, True) for k in range(2)]  # moves the watermark past all
    found, progress = run(spark, tmp_path, EVENT, [*dealt(rng, events, 4), end[:1], end[1:]], lambda s: getattr(ordered, name)(s, *args, "5 minutes"))
    want = getattr(limits, name)(spark.createDataFrame(events, EVENT), *args).collect()
    assert sorted(tuple(r) for r in found if r.key != "end") == sorted(tuple(r) for r in want)
    assert progress.stateOperators[0].numRowsTotal < 30  # what waits of the last key, and states that never rest


def fold(events, lease):
    """The states of one job's events in order, leases that ran out between them included."""
    job, out = ordered.NO_JOB, []
    for _, ts, event_id, event, worker in sorted(events, key=lambda e: (e[1], e[2])):
        at = (ts - datetime(1970, 1, 1)).total_seconds()
        if ordered.expire(job, at) != job:
            job = ordered.expire(job, at)
            out.append((None, "expire", *job))
        job = ordered.job_step(job, at, event, worker, lease)
        out.append((event_id, event, *job))
    if ordered.expire(job, 1e12) != job:
        out.append((None, "expire", *ordered.expire(job, 1e12)))
    return out


def test_leases_expire_by_event_time(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["enqueue", "claim", "claim", "extend", "extend", "complete", "fail", "reject", "retry", "crash", "sweep"]
    events = [(j, START, 100_000 + j, "enqueue", "") for j in range(6)]
    events += [(rng.randrange(6), START + timedelta(seconds=rng.randrange(1, 2500)), k, rng.choice(kinds), f"w{rng.randrange(2)}") for k in range(220)]
    end = [(99, START + timedelta(days=1 + k), 1000 + k, "enqueue", "") for k in range(2)]
    found, _ = run(spark, tmp_path, JOB_EVENT, [*dealt(rng, events, 3), end[:1], end[1:]], lambda s: ordered.job_leases(s, 90.0, "5 minutes"))
    for j in range(6):
        got = sorted((tuple(r)[1:] for r in found if r.job_id == j), key=repr)
        assert got == sorted(fold([e for e in events if e[0] == j], 90.0), key=repr)
    assert any(r.event == "expire" for r in found)


def test_lease_rules():
    queued = ordered.job_step(ordered.NO_JOB, 10.0, "enqueue", "", 60)
    running = ordered.job_step(queued, 20.0, "claim", "w1", 60)
    assert running == ("running", 0, 10.0, 80.0, "w1") and ordered.job_step(queued, 5.0, "claim", "w1", 60) == queued
    assert ordered.job_step(running, 30.0, "extend", "w2", 60) == running and ordered.job_step(running, 30.0, "extend", "w1", 60)[3] == 90.0
    assert ordered.expire(running, 79.0) == running and ordered.expire(running, 80.0) == ("failed", 0, 80.0, 0.0, "")
    assert ordered.job_step(running, 30.0, "sweep", "w1", 60) == running and ordered.job_step(running, 30.0, "sweep", "w2", 60) == ("failed", 0, 30.0, 0.0, "")
    done = ordered.job_step(running, 30.0, "complete", "w1", 60)
    assert done[0] == "done" and ordered.job_step(done, 31.0, "fail", "w1", 60) == done and ordered.job_step(queued, 31.0, "complete", "w1", 60) == queued
    assert ordered.job_step(running, 30.0, "fail", "w1", 60) == ("failed", 1, 60.0, 0.0, "") and ordered.job_step(running, 30.0, "reject", "w1", 60)[:2] == ("dead", 1)
