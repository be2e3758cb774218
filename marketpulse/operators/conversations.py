"""Conversation tables: sessions and messages.

Sessions and messages are keyed tables; every operator is a filter, join or
aggregate on the session key.  Ids and times are inputs (no uuid() / now()
inside a plan), so re-running a job gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.operators import quality as q
from marketpulse.operators import tables as tb
from marketpulse.operators.series import index_series

# Fixed value: prefix of generated session titles ("new conversation N").
DEFAULT_TITLE_PREFIX = "新對話 "


def count_default_titles(sessions: DataFrame, prefix: str = DEFAULT_TITLE_PREFIX) -> DataFrame:
    """A4 (+F5): one row, the number of sessions whose title starts with ``prefix``."""
    return q.title_prefix(sessions, "title", prefix).agg(F.count(F.lit(1)).alias("n_default"))


def number_titles(new: DataFrame, sessions: DataFrame, order: str = "created_at",
                  prefix: str = DEFAULT_TITLE_PREFIX) -> DataFrame:
    """Titles ``prefix + (count + n)`` for a batch of new sessions, where
    ``count`` is the number of existing default-titled sessions and ``n`` the
    1-based position of the new session in ``order``.

    Rows without a title get the generated one; the position is computed by
    the bucketed series index, so a large batch is not sorted in one task.
    """
    n0 = count_default_titles(sessions, prefix).scalar()
    indexed = index_series(new.withColumn("_g", F.lit(0)), ["_g"], order, tie=["id"], idx="_pos")
    gen = F.concat(F.lit(prefix), (n0 + F.col("_pos") + F.lit(1)).cast("string"))
    cols = [c for c in new.columns if c != "title"]
    return indexed.select(*cols, F.coalesce(F.col("title"), gen).alias("title"))


def history(messages: DataFrame, session_id: str) -> DataFrame:
    """(pos, sender, message, created_at) of one session, oldest first."""
    return (histories(q.by_key(messages, "session_id", session_id))
              .select("pos", "sender", "message", "created_at").orderBy("pos"))


def histories(messages: DataFrame) -> DataFrame:
    """L5 for every session at once: message position per session by time
    (from 1; ties by id).  A session with very many messages is numbered in
    buckets, not in one task."""
    rows = index_series(messages, ["session_id"], "created_at", tie=["id"], idx="pos")
    return rows.withColumn("pos", F.col("pos") + 1)


def list_sessions(sessions: DataFrame) -> DataFrame:
    """(pos, id, title, created_at), newest first (ties: the later id first)."""
    n = sessions.agg(F.count(F.lit(1))).scalar()
    rows = index_series(sessions.withColumn("_g", F.lit(0)), ["_g"], "created_at", tie=["id"], idx="_i")
    return rows.select((n - F.col("_i")).alias("pos"), "id", "title", "created_at").orderBy("pos")


def validate_messages(messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C6 checks (F6 + Q3 + Q4): returns (accepted, rejected-with-reason).

    A message is rejected when session_id, sender or message is missing or
    empty, when the sender is not user/bot, or when its session is unknown.
    """
    known = sessions.select(F.col("id").alias("_sid")).withColumn("_known", F.lit(True))
    j = messages.join(known, F.col("session_id") == F.col("_sid"), "left")
    reason = (F.when(q.missing(F.col("session_id")) | q.missing(F.col("sender"))
                     | q.missing(F.col("message")), F.lit("missing field"))
               .when(~F.col("sender").isin(q.SENDERS), F.lit("bad sender"))
               .when(F.col("_known").isNull(), F.lit("unknown session")))
    flagged = j.withColumn("reason", reason).drop("_sid", "_known")
    return (flagged.where(F.col("reason").isNull()).drop("reason"),
            flagged.where(F.col("reason").isNotNull()))


def append_messages(messages: DataFrame, batch: DataFrame, sessions: DataFrame) -> DataFrame:
    """The message table after appending the valid rows of ``batch``."""
    ok, _ = validate_messages(batch, sessions)
    return tb.append_rows(messages, ok.select(*messages.columns))


def create_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """The session table after adding ``new`` (id, created_at, title?);
    missing titles are numbered (W13)."""
    if "title" not in new.columns:
        new = new.withColumn("title", F.lit(None).cast("string"))
    titled = number_titles(new, sessions)
    return tb.append_rows(sessions, titled.select(*sessions.columns))


def rename_sessions(sessions: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Set titles from ``changes`` (id, new_title, ``order``); empty titles
    are rejected (F6), unknown ids change nothing, and of several renames of a
    session the last wins."""
    ok, _ = q.require(changes, ["new_title"])
    return tb.keyed_update(sessions, ok, "id", "title", order, new_col="new_title")


def delete_sessions(sessions: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the sessions and, by cascade, their messages."""
    return tb.delete_cascade(sessions, messages, ids, "id", "session_id")
