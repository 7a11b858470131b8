"""Conversation tables: history windows, titles, status changes."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import collect_by_rank
from plumbline.functions.text import session_title
from plumbline.operators.fusion import rank_within
from plumbline.plans.segments import previous, trailing_rows

HISTORY_MESSAGES, HISTORY_CHARS = 6, 500


def _finished(messages: DataFrame) -> DataFrame:
    done = messages.where(F.coalesce(F.col("content"), F.lit("")) != "")
    return done.where(~F.coalesce(F.col("streaming"), F.lit(False))) if "streaming" in messages.columns else done


def _turn(max_chars: int) -> Column:
    return F.struct("role", F.substring("content", 1, max_chars).alias("content"))


def history_window(messages: DataFrame, n: int = HISTORY_MESSAGES, max_chars: int = HISTORY_CHARS,
                   session: str = "session_id", order: str = "turn") -> DataFrame:
    """Last ``n`` finished messages of each session, oldest first, cut, as one array.

    The rank filter is applied before the shuffle, so a long session sends ``n`` rows per task.
    """
    last = rank_within(_finished(messages), [session], [F.col(order).desc()], n, "_back")
    return (last.select(session, (-F.col("_back")).alias("_pos"), "role", "content")
            .groupBy(session).agg(collect_by_rank("_pos", _turn(max_chars)).alias("history")))


def history_at_each_turn(messages: DataFrame, n: int = HISTORY_MESSAGES, max_chars: int = HISTORY_CHARS,
                         session: str = "session_id", order: str = "turn", rows: int = 100_000) -> DataFrame:
    """Each finished message with the ``n`` before it.  Long sessions are cut into segments of about ``rows`` turns."""
    return trailing_rows(_finished(messages), [session], [order], _turn(max_chars), n, rows, "history")


def session_titles(messages: DataFrame, session: str = "session_id", order: str = "turn") -> DataFrame:
    """Title of each session: the start of its first user message.  ``min_by`` merges on the map side."""
    return (messages.where(F.col("role") == "user").groupBy(session)
            .agg(session_title(F.min_by("content", order)).alias("title")))


def newly_indexed(status_log: DataFrame, key: str = "file_id", order: list[str] | None = None,
                  target: str = "indexed", rows: int = 100_000) -> DataFrame:
    """Log rows whose status became ``target`` from another known status.  Long logs are cut into segments of about ``rows`` rows."""
    log = previous(status_log, [key], order or ["ts"], F.col("status"), rows, "previous_status")
    return log.where((F.col("status") == target) & (F.col("previous_status") != target))


def message_listing(messages: DataFrame) -> DataFrame:
    return messages.orderBy("session_id", "created_at", "message_id")
