"""Sequential limiters: sliding-log rate limits, token buckets, circuit breakers.

Whether an event is let through depends on which earlier ones were, so a key's events are walked in order. They reach a task sorted and are
read in batches with a few numbers of state, so a key with very many events costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SLIDING_LOG, TOKEN_BUCKET, CIRCUIT_BREAKER = "allowed boolean, retry_after long", "allowed boolean, left double", "state string, failures long"  # what is told of an event


def _walk(events: DataFrame, columns: list[str], out: str, step: Callable[..., tuple[tuple, tuple]]) -> DataFrame:
    """events (key, ts, event_id, ...columns) step by step for each key, in order of time and id. ts is handed over in seconds."""
    schema = ", ".join(["key string", "event_id long", out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, ()
        for batch in batches:
            rows = []
            for k, seconds, event, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, state = k, ()
                state, told = step(state, seconds, *rest)
                rows.append((k, event, *told))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[p.split()[0] for p in schema.split(", ")])

    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ordered = events.select(F.col("key").cast("string").alias("key"), seconds.alias("seconds"), F.col("event_id").cast("long"), *columns).repartition("key").sortWithinPartitions("key", "seconds", "event_id")
    return ordered.mapInArrow(run, schema)


# Each limiter as a step from a state (a tuple of numbers, or an empty one at first) and an event to the next state and what is told of the event; batches and streams take the same steps.
Step = Callable[..., tuple[tuple, tuple]]


def sliding_log_step(most: int, window_seconds: float) -> Step:
    def step(passed: tuple, now: float) -> tuple[tuple, tuple]:
        passed = tuple(t for t in passed if now - t < window_seconds)
        if len(passed) < most:
            return (*passed, now), (True, 0)
        return passed, (False, max(1, int(window_seconds - (now - passed[0]))))

    return step


def token_bucket_step(capacity: float, per_second: float) -> Step:
    def step(state: tuple, now: float, cost: float) -> tuple[tuple, tuple]:
        left, last = state or (capacity, now)
        left = min(capacity, left + max(0.0, now - last) * per_second)
        fits = cost <= left
        if fits:
            left = min(capacity, left - cost)
        return (left, now), (fits, round(left, 9))

    return step


def circuit_breaker_step(threshold: int, cooldown_seconds: float) -> Step:
    def step(state: tuple, now: float, ok: bool) -> tuple[tuple, tuple]:
        failures, until = state or (0, -1.0)
        if now < until:
            return (failures, until), ("open", int(failures))
        if ok:
            return (), ("closed", 0)
        failures += 1
        if failures >= threshold:
            return (failures, now + cooldown_seconds), ("open", int(failures))
        return (failures, -1.0), ("closed", int(failures))

    return step


def sliding_log(events: DataFrame, most: int, window_seconds: float) -> DataFrame:
    """(key, event_id, allowed, retry_after): an event passes if fewer than most passed in the window before it. Rejected ones don't count."""
    return _walk(events, [], SLIDING_LOG, sliding_log_step(most, window_seconds))


def token_bucket(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """(key, event_id, allowed, left): events take `cost` tokens from a bucket that refills; a negative cost gives back."""
    return _walk(events, ["cost"], TOKEN_BUCKET, token_bucket_step(capacity, per_second))


def circuit_breaker(events: DataFrame, threshold: int, cooldown_seconds: float) -> DataFrame:
    """(key, event_id, state, failures) after calls with `ok`: so many failures on end open the circuit; calls while open aren't made; after the cooldown one call may try."""
    return _walk(events, ["ok"], CIRCUIT_BREAKER, circuit_breaker_step(threshold, cooldown_seconds))
