"""Priorities, backoffs, intervals and time windows, all against an explicit as_of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_BACKOFF_SECONDS, MAX_RETRIES, PAUSE_AFTER = 30, 5, 10


def age_seconds(as_of: Column, since: Column) -> Column:
    return F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(since.cast("timestamp"))


def effective_priority(priority: Column, age: Column) -> Column:
    """One more for every whole hour of waiting; a negative age counts as none."""
    return (priority + F.floor(F.greatest(age, F.lit(0)) / 3600)).cast("int")


def backoff_seconds(attempts: Column, least: int = MIN_BACKOFF_SECONDS) -> Column:
    """least, doubled with every attempt after the first, 30 times at most."""
    return F.call_function("shiftleft", F.lit(least).cast("long"), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(30)).cast("int"))


def failed_status(attempts_after: Column, permanent: Column, max_retries: int = MAX_RETRIES) -> Column:
    return F.when(permanent | (attempts_after >= max_retries), "dead").otherwise("failed")


def clamp_interval(requested: Column, least: int, most: int) -> Column:
    return F.least(F.greatest(requested, F.lit(least)), F.lit(most))


def next_fetch(as_of: Column, interval_seconds: Column, least: int) -> Column:
    return as_of + F.make_dt_interval(secs=F.greatest(F.lit(least), F.coalesce(interval_seconds, F.lit(least))))


def refetch_backoff(failures: Column, base: int, cap: int) -> Column:
    """Seconds to the next try after so many failures; null (paused) from the tenth on."""
    wait = F.least(F.lit(cap).cast("long"), F.call_function("shiftleft", F.lit(base).cast("long"), F.least(failures, F.lit(5)).cast("int")))
    return F.when(failures < PAUSE_AFTER, wait)


def in_time_window(ts: Column, hours: Sequence[tuple[int, int]], days: Sequence[int]) -> Column:
    """Whether the hour is in any [start, end) and the weekday (Monday 0) is listed; no list means any."""
    by_hour = F.lit(not hours)
    for start, end in hours:
        by_hour = by_hour | ((F.hour(ts) >= start) & (F.hour(ts) < end))
    return by_hour & (F.weekday(ts).isin(*days) if days else F.lit(True))


def watch_days(schedule: Column) -> Column:
    return F.when(schedule == "daily", 1).when(schedule == "weekly", 7).when(schedule == "monthly", 30)


def department_schedule(department: Column) -> Column:
    return F.when(department.isin("legal", "compliance-risk"), "weekly").when(department.isin("accounting", "finance", "tax"), "monthly").otherwise("weekly")


def maintenance_due(as_of: Column, last: Column, hours: float) -> Column:
    return last.isNull() | (age_seconds(as_of, last) >= int(hours * 3600))


def backup_is_stale(age_hours: Column, most: float) -> Column:
    return age_hours.isNull() | (age_hours > most)
