"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch that goes to a Python worker. Texts can be long, and a
#: worker holds a whole batch.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small for the session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder of spark.checkpoint.dir; only a session of one machine may do without and gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="codeloom-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder, without their lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, per_task: int = 1 << 16) -> DataFrame:
    """``df`` cut, in as few partitions as hold its rows by ``per_task``: small frames needn't be as many files as large shuffles."""
    rows = cut(df)
    return rows.coalesce(max(1, -(-rows.count() // per_task)))


#: A key with over one in so many of all rows is hot; so there are fewer hot keys than this.
HOT = 1024


def hot_join(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row for each key and in ``count`` how many of ``rows`` have it.

    The facts of hot keys, fewer than ``HOT``, are broadcast, so their rows stay where they are; only the others
    are dealt out by their keys.
    """
    if total is None:
        total = facts.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > total / HOT
    values = F.struct(*[c for c in facts.columns if c != key]).alias("_hot")
    marked = rows.join(F.broadcast(facts.where(is_hot).select(key, values)), key, "left")
    rest = marked.where("_hot is null").drop("_hot").join(facts.where(~is_hot), key)
    return marked.where("_hot is not null").select(*rows.columns, "_hot.*").unionByName(rest)
