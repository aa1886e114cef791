"""Action items, due dates, response checks, path classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, rough_tokens

# Phrases that announce an action, month and day names.
REMINDER = r"(?i)remind\s+me\s+to\s+(.+?)\s+(?:by|on|before)\s+(.+)"
DATED_TASK = r"(?i)(?:task|todo):\s*(.+?)\s+(?:due|by)\s+(.+)"
TASK = r"(?i)(?:task|todo):\s*(.+)"
DECISION = r"(?i)(?:decision|decided):\s*(.+)"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def due_date(phrase: Column, as_of: Column) -> Column:
    """ISO date of a phrase seen on the day as_of; null if it names none. A weekday is the next one after that day; a month and day that have passed are next year's."""
    text = F.regexp_replace(F.trim(phrase), r"^[,.;!?]+|[,.;!?]+$", "")
    low = F.lower(text)
    out = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    for names, days in ((("today", "tod"), 0), (("tomorrow", "tmrw"), 1), (("day after tomorrow",), 2), (("next week",), 7)):
        out = out.when(low.isin(*names), F.date_add(as_of, days).cast("string"))
    in_days = F.regexp_extract(low, r"in\s+(\d+)\s+days?", 1)
    out = out.when(in_days != "", F.date_add(as_of, in_days.try_cast("int")).cast("string"))
    for day in WEEKDAYS:
        out = out.when(low.contains(day), F.next_day(as_of, day[:3]).cast("string"))
    for names in (MONTHS, tuple(m[:3] for m in MONTHS)):
        for number, name in enumerate(names, 1):
            day = F.regexp_extract(low, name + r"\D*?(\d{1,2})", 1).try_cast("int")
            this = F.try_make_timestamp(F.year(as_of), F.lit(number), day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
            later = F.try_make_timestamp(F.year(as_of) + 1, F.lit(number), day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
            out = out.when(low.contains(name) & day.isNotNull(), F.when(this < as_of, later).otherwise(this).cast("string"))
    return out


def actions(text: Column, as_of: Column) -> Column:
    """array<struct<kind, text, due>>: reminders, dated tasks, tasks whose text no dated one has, decisions."""

    def dated(pattern: str, kind: str) -> Column:
        firsts, seconds = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return F.zip_with(firsts, seconds, lambda a, b: F.struct(F.lit(kind).alias("kind"), F.trim(a).alias("text"), due_date(F.trim(b), as_of).alias("due")))

    def undated(pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda a: F.struct(F.lit(kind).alias("kind"), F.trim(a).alias("text"), F.lit(None).cast("string").alias("due")))

    tasks = let(dated(DATED_TASK, "task"), lambda known: F.concat(known, F.filter(undated(TASK, "task"), lambda t: ~F.exists(known, lambda k: k["text"] == t["text"]))))
    return F.concat(dated(REMINDER, "reminder"), tasks, undated(DECISION, "decision"))


def pending_list(items: Column) -> Column:
    """Bullet lines of action items."""
    line = lambda i: F.when(i["kind"] == "decision", F.concat(F.lit("- Decision: "), i["text"])).otherwise(F.concat(F.lit("- Task: "), i["text"], F.coalesce(F.concat(F.lit(" (due: "), i["due"], F.lit(")")), F.lit(""))))
    return F.array_join(F.transform(items, lambda i: F.concat(line(i), F.lit("\n"))), "")


def response_issues(prompt: Column, response: Column, least_tokens: int, markers: Sequence[str] = ("remember", "as discussed")) -> Column:
    """Names of what is wrong with a response: empty, short for its prompt, or without a memory marker that the prompt has."""
    empty = F.trim(F.coalesce(response, F.lit(""))) == ""
    short = ~empty & (rough_tokens(response) < least_tokens) & (F.length(prompt) > 20)
    lost = F.lit(False)
    for m in markers:
        lost = lost | (F.lower(prompt).contains(m) & ~F.lower(F.coalesce(response, F.lit(""))).contains(m))
    return F.filter(F.array(F.when(empty, "empty"), F.when(short, "short"), F.when(lost, "memory")), lambda x: x.isNotNull())


def path_class(path: Column, sensitive: Sequence[str]) -> Column:
    """confidential if any path component is a sensitive department, else internal for a file without a folder and public for all others."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.when(F.arrays_overlap(parts, F.array(*map(F.lit, sensitive))), "confidential").when(F.size(parts) == 1, "internal").when(path.isNotNull(), "public")


def glob_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern) + "$"


def matches_any_glob(name: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(glob_regex(p))
    return out
