"""Conversations: last messages, contexts, ownership, action items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import notes


def last_messages(messages: DataFrame, n: int, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The last n messages of each conversation (conv_id, turn, role, text), of these roles."""
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return messages.where(F.col("role").isin(*roles)).withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def contexts(messages: DataFrame, n: int, hits: DataFrame | None = None) -> DataFrame:
    """(conv_id, context): `role: text` lines of the last n messages in order, after the sources' context if there is one (conv_id, context)."""
    line = F.concat("role", F.lit(": "), F.col("text"))
    told = last_messages(messages, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines")).select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("said"))
    if hits is None:
        return told.select("conv_id", F.col("said").alias("context"))
    return told.join(hits, "conv_id", "left").select("conv_id", F.concat_ws("\n\n", "context", "said").alias("context"))


def owned(messages: DataFrame, conversations: DataFrame, user_id: int) -> DataFrame:
    return messages.join(conversations.where(F.col("user_id") == user_id).select("conv_id"), "conv_id", "left_semi")


def action_items(messages: DataFrame, as_of: str) -> DataFrame:
    """(conv_id, turn, position, kind, item, due) of what the messages announce."""
    found = messages.select("conv_id", "turn", F.posexplode(notes.actions(F.col("text"), F.lit(as_of).cast("date"))).alias("position", "a"))
    return found.select("conv_id", "turn", "position", "a.kind", F.col("a.text").alias("item"), "a.due")


def valid_sessions(sessions: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """sessions of known users that have not run out."""
    return sessions.where(F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")).join(users, "user_id", "left_semi")
