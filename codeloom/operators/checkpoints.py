"""Cutting lineage between the steps of an iteration, and shared folders for stored tables."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a session of one machine may do without and gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codeloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for a table that later steps read in part."""
    return f"{_shared(spark)}/{name}-{uuid4().hex}"
