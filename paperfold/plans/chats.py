"""Conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperfold.operators import browse, chats
from paperfold.plans.registry import query

_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_TITLE = f"CASE WHEN {_FLAT} = '' THEN 'New chat' WHEN length({_FLAT}) <= 80 THEN {_FLAT} ELSE rtrim(substr({_FLAT}, 1, 79)) || '…' END"


def _messages(t):
    return t.conversations.selectExpr("conv_id AS session_id", "turn AS position", "role", "text AS content")


def _sessions(t):
    # A session was used last in the order of its total text length.
    return t.conversations.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.sum(F.length("text")).alias("updated_at"), F.min_by("text", "turn").alias("title")
    )


@query(
    "chat_list",
    rf"""WITH s AS (SELECT conv_id AS session_id, sum(length(text))::BIGINT AS updated_at, count(*) AS message_count,
      arg_max(text, turn) AS text FROM conversations GROUP BY 1)
    SELECT session_id, updated_at, message_count, substr({_FLAT}, 1, 120) AS last_message_preview FROM s
    ORDER BY updated_at DESC, session_id LIMIT 200""",
)
def chat_list(t):
    return chats.session_list(_sessions(t), _messages(t)).drop("title")


@query(
    "appended_turns",
    """WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role <> 'system' GROUP BY 1),
    q AS (SELECT c.conv_id, COALESCE(last, -1) AS last FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m USING (conv_id)
          UNION ALL SELECT -1 - page_id, -1 FROM pages)
    SELECT conv_id AS session_id, last + 1 AS position, 'user' AS role, 'why ' || conv_id AS content FROM q
    UNION ALL SELECT conv_id, last + 2, 'assistant', 'because' FROM q""",
)
def appended_turns(t):
    old = t.conversations.select("conv_id").distinct()
    asked = old.unionByName(t.pages.selectExpr("-1 - page_id AS conv_id")).selectExpr(
        "conv_id AS session_id", "'why ' || conv_id AS question", "'because' AS answer"
    )
    return chats.append_turns(_messages(t).filter("role <> 'system'"), asked)


@query("chat_titles", f"SELECT conv_id, turn, {_TITLE} AS title FROM conversations")
def chat_titles(t):
    return t.conversations.select("conv_id", "turn", chats.derive_title("text").alias("title"))


@query("transcripts", "SELECT conv_id AS session_id, turn AS position, role, text AS content FROM conversations")
def transcripts(t):
    return chats.transcript(_messages(t))


@query(
    "renamed_chats",
    rf"""WITH s AS (SELECT conv_id AS session_id, arg_min(text, turn) AS title, arg_max(text, turn) AS text FROM conversations GROUP BY 1)
    SELECT session_id, CASE WHEN session_id % 3 = 0 THEN substr({_FLAT}, 1, 80) ELSE title END AS title,
    CASE WHEN session_id % 3 = 1 THEN 'title cannot be empty' END AS error FROM s""",
)
def renamed_chats(t):
    last = _messages(t).groupBy("session_id").agg(F.max_by("content", "position").alias("text"))
    renames = last.filter("session_id % 3 < 2").selectExpr("session_id", "if(session_id % 3 = 0, text, '  ') AS new_title")
    return chats.rename_sessions(_sessions(t), renames).select("session_id", "title", "error")


@query(
    "chats_after_delete",
    """SELECT conv_id AS session_id, count(*) AS messages FROM conversations
    WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1""",
)
def chats_after_delete(t):
    doomed = _messages(t).filter("role = 'system'")
    _, left = chats.delete_sessions(_sessions(t), _messages(t), doomed)
    return left.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "json_safe_rows",
    """SELECT '{"o_orderkey":' || o_orderkey || ',"total":"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
    || '","day":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '","status":"' || o_orderstatus || '"}' AS row_json FROM orders""",
)
def json_safe_rows(t):
    rows = t.orders.selectExpr(
        "o_orderkey",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS total",
        "CAST(o_orderdate AS DATE) AS day",
        "o_orderstatus AS status",
    )
    return browse.json_safe(rows)
