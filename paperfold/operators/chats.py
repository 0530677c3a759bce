"""Conversation tables: lists, turns, titles and transcripts.

messages: session_id, position, role, content; sessions: session_id, title,
updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.text import PREVIEW_CHARS, TITLE_CHARS, collapse_sql, title_sql

LIST_LIMIT = 200


def derive_title(question: str) -> Column:
    """The opening question on one line, at most 80 characters, or "New chat"."""
    return F.expr(title_sql(question))


def session_list(sessions: DataFrame, messages: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Most recently used first, with message count and a preview of the last message.

    Last means highest position: a question and its answer share a timestamp.
    The limit comes first, so only listed sessions are summarised.
    """
    listed = sessions.orderBy(F.col("updated_at").desc(), "session_id").limit(limit)
    per_session = messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max_by("content", "position").alias("__last")
    )
    return (
        listed.join(per_session, "session_id", "left")
        .withColumn("message_count", F.coalesce("message_count", F.lit(0)))
        .withColumn("last_message_preview", F.substring(F.expr(collapse_sql("coalesce(__last, '')")), 1, PREVIEW_CHARS))
        .withColumn("last_message_preview", F.when(F.col("message_count") > 0, F.col("last_message_preview")))
        .drop("__last")
        .orderBy(F.col("updated_at").desc(), "session_id")
    )


def append_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages to add for (session_id, question, answer): the next two positions."""
    last = messages.groupBy("session_id").agg(F.max("position").alias("__last"))
    both = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit(2).alias("step"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    return (
        turns.join(last, "session_id", "left")
        .select("session_id", F.coalesce("__last", F.lit(-1)).alias("__last"), F.explode(both).alias("m"))
        .select(
            "session_id", (F.col("__last") + F.col("m.step")).cast("bigint").alias("position"), "m.role", "m.content"
        )
    )


def transcript(messages: DataFrame, session_id=None) -> DataFrame:
    """Messages by position, never by timestamp; of one session or of all."""
    chosen = messages if session_id is None else messages.filter(F.col("session_id") == session_id)
    return chosen.orderBy("session_id", "position")


def rename_sessions(sessions: DataFrame, renames: DataFrame) -> DataFrame:
    """Sessions with new titles (session_id, new_title), cut to 80; blank is refused."""
    flat = renames.select("session_id", F.expr(collapse_sql("new_title")).alias("__flat"), F.lit(True).alias("__asked"))
    blank = F.coalesce(F.col("__flat"), F.lit("")) == ""
    return (
        sessions.join(flat, "session_id", "left")
        .withColumn("error", F.when(F.col("__asked") & blank, "title cannot be empty"))
        .withColumn("title", F.when(~blank, F.substring("__flat", 1, TITLE_CHARS)).otherwise(F.col("title")))
        .drop("__flat", "__asked")
    )


def delete_sessions(sessions: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) without the doomed sessions (session_id)."""
    ids = doomed.select("session_id").distinct()
    return sessions.join(ids, "session_id", "left_anti"), messages.join(ids, "session_id", "left_anti")
