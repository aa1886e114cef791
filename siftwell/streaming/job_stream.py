"""The job queue's state machine over a stream of events: one state for each job, kept by Spark's state store."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.schedule import MAX_RETRIES, MIN_BACKOFF_SECONDS

STATE = "status string, attempts int, run_after double"
OUT = "job_id long, seq long, event string, status string, attempts int, run_after double"


def advance(status: str, attempts: int, run_after: float, event: str, at: float) -> tuple[str, int, float]:
    """The next state. Events that the state doesn't allow change nothing; a job that lost its lease may be claimed again at once, without an attempt."""
    if event == "enqueue":
        return ("queued", 0, at) if status == "" else (status, attempts, run_after)
    if event == "claim" and status in ("queued", "failed") and run_after <= at:
        return "running", attempts, run_after
    if event == "complete" and status == "running":
        return "done", attempts, run_after
    if event == "lose" and status == "running":
        return "failed", attempts, at
    if event in ("fail", "reject") and status == "running":
        n = attempts + 1
        if event == "reject" or n >= MAX_RETRIES:
            return "dead", n, run_after
        return "failed", n, at + MIN_BACKOFF_SECONDS * 2 ** min(n - 1, 30)
    if event == "retry" and status in ("failed", "dead"):
        return "queued", 0, at
    return status, attempts, run_after


def job_states(events: DataFrame) -> DataFrame:
    """Every event (job_id, seq, event, at in seconds) with the state it leads to. Events of a micro-batch are taken in order of seq."""

    def fold(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("", 0, 0.0)
        rows = []
        for seq, event, at in sorted(((int(r.seq), r.event, float(r.at)) for f in frames for r in f.itertuples())):
            now = advance(*now, event, at)
            rows.append((key[0], seq, event, *now))
        state.update(now)
        yield pd.DataFrame(rows, columns=["job_id", "seq", "event", "status", "attempts", "run_after"])

    return events.groupBy("job_id").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
