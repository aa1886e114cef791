"""Sequential operators over streams: events of a key are kept until the watermark has passed them and then taken in order, so a stream tells the same as a batch however its events
are dealt to micro-batches. Events later than the watermark are dropped. State lives in Spark's RocksDB store and goes once a key is idle and its state is what a fresh one would be.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.schedule import MAX_RETRIES, MIN_BACKOFF_SECONDS
from ..operators import limits

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these streams need, for streams started in this session from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _InOrder(StatefulProcessor):
    """Keeps a key's rows, sets an event-time timer for each, and hands them to `take` in order of time and id once the watermark has passed."""

    waiting_schema: T.StructType  # at (seconds), event_id, and what the step needs
    state_schema: T.StructType
    columns: list[str]  # of the output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        names = self.waiting_schema.names
        for frame in rows:
            self.waiting.appendList([tuple(r) for r in frame[names].astype(object).itertuples(index=False)])
            for at in frame["at"].unique():
                self.handle.registerTimer(_millis(at))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(r) for r in rows if _millis(r[0]) <= now), key=lambda r: r[:2])
        if due:
            rest = [tuple(r) for r in rows if _millis(r[0]) > now]
            self.waiting.put(rest) if rest else self.waiting.clear()
        told = list(self.take(due, now))
        if told:
            yield pd.DataFrame([(key[0], *t) for t in told], columns=self.columns)

    def take(self, due: list[tuple], now: int) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _millis(seconds: float) -> int:
    """The first whole millisecond at which a time has passed."""
    return int(-(-seconds * 1000 // 1))


class _Limiter(_InOrder):
    """state: the numbers of a limiter's state, with the time after which an idle key is like a fresh one."""

    waiting_schema = T.StructType([T.StructField("at", T.DoubleType()), T.StructField("event_id", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("ok", T.BooleanType())])
    state_schema = T.StructType([T.StructField("numbers", T.ArrayType(T.DoubleType())), T.StructField("over", T.LongType())])

    def __init__(self, step: limits.Step, extra: str | None, rest_seconds: float | None, out: str) -> None:
        self.step, self.extra, self.rest, self.columns = step, extra, rest_seconds, ["key", "event_id", *(c.split()[0] for c in out.split(", "))]

    def take(self, due: list[tuple], now: int) -> Iterator[tuple]:
        kept = self.state.get() if self.state.exists() else None
        state = tuple(kept[0]) if kept else ()
        for at, event_id, cost, ok in due:
            state, told = self.step(state, at, *({"cost": [cost], "ok": [ok]}[self.extra] if self.extra else []))
            yield event_id, *told
        if due:
            last = due[-1][0]
            if not state:
                self.state.clear()
                return
            over = _millis(last + self.rest) + 1 if self.rest is not None else 0
            self.state.update(([float(x) for x in state], over))
            if over:
                self.handle.registerTimer(over)
        elif kept and kept[1] and kept[1] <= now and not self.waiting.exists():
            self.state.clear()


def _limited(events: DataFrame, delay: str, step: limits.Step, extra: str | None, rest: float | None, out: str) -> DataFrame:
    use_rocksdb(events.sparkSession)
    told = {c: F.col(c) if c == extra else F.lit(None) for c in ("cost", "ok")}
    stamp = F.col("ts").cast("timestamp")
    rows = events.select(F.col("key").cast("string").alias("key"), stamp.alias("stamp"), (F.unix_micros(stamp) / 1e6).alias("at"), F.col("event_id").cast("long").alias("event_id"), told["cost"].cast("double").alias("cost"), told["ok"].cast("boolean").alias("ok"))
    return rows.withWatermark("stamp", delay).groupBy("key").transformWithStateInPandas(_Limiter(step, extra, rest, out), f"key string, event_id long, {out}", "append", "eventTime")


def sliding_log(events: DataFrame, most: int, window_seconds: float, delay: str) -> DataFrame:
    """limits.sliding_log of a stream whose events come at most delay late. A key that was quiet for the window has no state."""
    return _limited(events, delay, limits.sliding_log_step(most, window_seconds), None, window_seconds, limits.SLIDING_LOG)


def token_bucket(events: DataFrame, capacity: float, per_second: float, delay: str) -> DataFrame:
    """limits.token_bucket of a stream. A key that was quiet for as long as an empty bucket takes to fill has no state."""
    return _limited(events, delay, limits.token_bucket_step(capacity, per_second), "cost", capacity / per_second if per_second > 0 else None, limits.TOKEN_BUCKET)


def circuit_breaker(events: DataFrame, threshold: int, cooldown_seconds: float, delay: str) -> DataFrame:
    """limits.circuit_breaker of a stream. A closed circuit without failures has no state; failures are remembered until a call succeeds."""
    return _limited(events, delay, limits.circuit_breaker_step(threshold, cooldown_seconds), "ok", None, limits.CIRCUIT_BREAKER)


JOB = ("status", "attempts", "run_after", "lease", "worker")
NO_JOB = ("", 0, 0.0, 0.0, "")


def job_step(job: tuple, at: float, event: str, worker: str, lease_seconds: float) -> tuple:
    """The next state of a job (JOB; no lease is zero and the empty name). Events that the state or the worker doesn't allow change nothing."""
    status, attempts, run_after, lease, owner = job
    if event == "enqueue" and status == "":
        return "queued", 0, at, 0.0, ""
    if event == "claim" and status in ("queued", "failed") and run_after <= at:
        return "running", attempts, run_after, at + lease_seconds, worker
    if event == "retry" and status in ("failed", "dead"):
        return "queued", 0, at, 0.0, ""
    if status != "running":
        return job
    if event == "extend" and worker == owner:
        return status, attempts, run_after, at + lease_seconds, owner
    if event == "complete":
        return "done", attempts, run_after, lease, owner
    if event in ("fail", "reject"):
        n = attempts + 1
        dead = event == "reject" or n >= MAX_RETRIES
        return "dead" if dead else "failed", n, run_after if dead else at + MIN_BACKOFF_SECONDS * 2 ** min(n - 1, 30), 0.0, ""
    if event == "crash" or (event == "sweep" and worker != owner):  # a worker was found dead; a worker began anew and asks what others held
        return "failed", attempts, at, 0.0, ""
    return job


def expire(job: tuple, at: float) -> tuple:
    """A running job whose lease ended by then may be claimed again from that end on, without an attempt."""
    status, attempts, _, lease, _ = job
    return ("failed", attempts, lease, 0.0, "") if status == "running" and lease <= at else job


class _Jobs(_InOrder):
    waiting_schema = T.StructType([T.StructField("at", T.DoubleType()), T.StructField("event_id", T.LongType()), T.StructField("event", T.StringType()), T.StructField("worker", T.StringType())])
    state_schema = T.StructType([T.StructField(n, k) for n, k in zip(JOB, (T.StringType(), T.IntegerType(), T.DoubleType(), T.DoubleType(), T.StringType()), strict=True)])

    def __init__(self, lease_seconds: float) -> None:
        self.lease_seconds, self.columns = lease_seconds, ["job_id", "event_id", "event", *JOB]

    def take(self, due: list[tuple], now: int) -> Iterator[tuple]:
        job = tuple(self.state.get()) if self.state.exists() else NO_JOB
        for at, event_id, event, worker in [*due, (now / 1000, None, None, None)]:
            late = expire(job, at)
            if late != job:
                job = late
                yield None, "expire", *job
            if event is not None:
                job = job_step(job, at, event, worker or "", self.lease_seconds)
                yield event_id, event, *job
        self.state.update(job)
        if job[0] == "running":
            self.handle.registerTimer(_millis(job[3]))


def job_leases(events: DataFrame, lease_seconds: float, delay: str) -> DataFrame:
    """Every event (job_id, event_id, event, worker, ts) of a stream with the state of its job after it, and a row of the event `expire` when a lease runs out: an event-time timer, set
    anew with every claim and extension, fires when the watermark reaches it. Events are taken in order of time and id."""
    use_rocksdb(events.sparkSession)
    stamp = F.col("ts").cast("timestamp")
    rows = events.select("job_id", stamp.alias("stamp"), (F.unix_micros(stamp) / 1e6).alias("at"), F.col("event_id").cast("long").alias("event_id"), "event", "worker")
    out = "job_id long, event_id long, event string, status string, attempts int, run_after double, lease double, worker string"
    return rows.withWatermark("stamp", delay).groupBy("job_id").transformWithStateInPandas(_Jobs(lease_seconds), out, "append", "eventTime")
