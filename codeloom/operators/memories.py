"""Memories and sessions of a project: what users approved, without secrets, and when work went on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import stable_hash
from codeloom.functions.text import SECRET_KEY_HINTS, contains_any, redact

#: Kinds that are accepted decisions, rejected attempts and open tasks.
DECISIONS, REJECTED, TASKS = ("decision", "accepted_solution"), ("rejected_attempt",), ("task",)
WIKI_KINDS = (*DECISIONS, *REJECTED, *TASKS)


def _stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def remembered(said: DataFrame) -> DataFrame:
    """Rows of the memories table from (kind, content, created_at): secret-like lines keep their key only, and ``redacted`` says so."""
    safe = said.select("kind", redact(F.coalesce("content", F.lit(""))).alias("content"), "created_at", contains_any(F.lower(F.coalesce("content", F.lit(""))), SECRET_KEY_HINTS).alias("redacted"))
    return safe.select(F.concat(F.lit("memory:"), stable_hash(F.col("kind"), F.col("content"), _stamp(F.col("created_at")), length=24)).alias("id"), "kind", "content", "created_at", "redacted").dropDuplicates(["id"])


def remember(memories: DataFrame, said: DataFrame) -> DataFrame:
    """Memories with what was said; the same words of the same time are one memory."""
    new = remembered(said)
    return memories.join(new.select("id"), "id", "left_anti").select(memories.columns).unionByName(new.select(memories.columns))


def forget(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Memories without those named by ``ids`` (id)."""
    return memories.join(ids.select("id"), "id", "left_anti").select(memories.columns)


def listed(memories: DataFrame, kinds: tuple[str, ...] = (), limit: int | None = 50) -> DataFrame:
    """The newest memories, of some kinds or all; ties by id."""
    rows = (memories.where(F.col("kind").isin(*kinds)) if kinds else memories).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.limit(limit) if limit is not None else rows


def by_kind(memories: DataFrame, at: str = "created_at") -> DataFrame:
    """(kind, n, newest): how many memories of each kind there are, and when the last was made."""
    return memories.groupBy("kind").agg(F.count("*").alias("n"), F.max(at).alias("newest"))


def told_sessions(sessions: DataFrame) -> DataFrame:
    """(kind, title, summary, created_at) with ids, row by row; rows that agree in all of them have one id."""
    key = stable_hash(F.col("kind"), F.col("title"), F.col("summary"), _stamp(F.col("created_at")), length=24)
    return sessions.select(F.concat(F.lit("session:"), key).alias("id"), "kind", "title", "summary", "created_at")


def session_rows(sessions: DataFrame) -> DataFrame:
    """Rows of the sessions table from (kind, title, summary, created_at), each id once."""
    return told_sessions(sessions).dropDuplicates(["id"])


def recent_sessions(sessions: DataFrame, limit: int = 10) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
