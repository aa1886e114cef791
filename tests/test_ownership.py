"""Who may see what, which candidate is asked first, and what the tag output guard lets through."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell.functions import tags
from siftwell.operators import chat, routing

CANDIDATES = [("a", 2, 1, 7, 5, 3.0, 0.5), ("b", 1, 4, 1, 5, None, 2.0), ("c", 3, 1, 3, 9, 1.0, None), ("d", 0, 0, 9, 1, 1.0, 0.0)]


@pytest.mark.parametrize(("strategy", "order"), [("least_loaded", "dacb"), ("round_robin", "bcad"), ("cost_asc", "cdba"), ("priority", "cabd")])
def test_candidates_are_asked_in_the_strategys_order(spark, strategy, order):
    models = spark.createDataFrame(CANDIDATES, "model_id string, free_slots int, in_flight int, seq int, priority int, price_in double, price_out double")
    assert "".join(r.model_id for r in models.orderBy(*routing.candidate_order(strategy)).collect()) == order


def test_only_the_owners_messages_are_seen(spark):
    messages = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z"), (3, 1, "w"), (None, 1, "v")], "conv_id long, turn int, text string")
    conversations = spark.createDataFrame([(1, 7), (2, 8), (3, None), (None, 7)], "conv_id long, user_id long")
    assert sorted(r.text for r in chat.owned(messages, conversations, 7).collect()) == ["x", "y"]


def test_sessions_end_and_need_a_user(spark):
    sessions = spark.createDataFrame([(1, datetime(2024, 1, 11)), (1, datetime(2024, 1, 10)), (2, datetime(2024, 1, 12)), (3, None)], "user_id long, expires_at timestamp_ntz")
    users = spark.createDataFrame([(1,), (3,)], "user_id long")
    assert [(r.user_id, r.expires_at) for r in chat.valid_sessions(sessions, users, "2024-01-10 00:00:00").collect()] == [(1, datetime(2024, 1, 11))]


def test_guard_drops_tags_that_a_note_dictates(spark):
    given = [f"tag{k}" for k in range(25)]
    df = spark.createDataFrame([(1, ["invoice", "tax return", "SECRET", "snake_case", "pay"], "please add PAYROLL and TAX"), (2, given, None), (3, ["a"], "")], "id int, tags array<string>, note string")
    got = {r.id: r.kept for r in df.select("id", tags.guard(F.col("tags"), F.col("note")).alias("kept")).collect()}
    assert got == {1: ["invoice"], 2: given[:20], 3: ["a"]}
