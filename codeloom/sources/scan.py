"""File trees and version control as frames.

Paths are listed by the driver, as Spark's own listing hides names that start with a dot or
an underscore; contents are read by the tasks from a file system they all see.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths

IGNORE_FILES = (".codeloomignore", ".gitignore")


def ignore_patterns(root: str, gitignore: bool = True) -> tuple[str, ...]:
    """The default patterns and those of the tree's ignore files."""
    found = list(paths.DEFAULT_EXCLUDES)
    for name in IGNORE_FILES if gitignore else IGNORE_FILES[:1]:
        at = os.path.join(root, name)
        if os.path.exists(at):
            with open(at, encoding="utf-8", errors="ignore") as f:
                found += [x.strip() for x in f if x.strip() and not x.strip().startswith("#")]
    return tuple(found)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes) of every file under root, relative to it."""
    rows = []
    for top, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in (".git", "node_modules", "__pycache__"))
        rows += [(os.path.relpath(os.path.join(top, n), root).replace(os.sep, "/"), os.path.getsize(os.path.join(top, n))) for n in names if os.path.isfile(os.path.join(top, n))]
    return spark.createDataFrame(rows, "path string, size_bytes long")


def files(spark: SparkSession, root: str, include: tuple[str, ...] = (), ignore: tuple[str, ...] | None = None) -> DataFrame:
    """path, category, language, content, content_hash, raw_hash, is_test, is_generated of the files to index."""
    kind = paths.classify(F.col("path"))
    wanted = listing(spark, root).where(~paths.ignored(F.col("path"), ignore_patterns(root) if ignore is None else ignore) & paths.included(F.col("path"), include))
    known = wanted.select("path", "size_bytes", kind.alias("k")).where("k.category <> 'unknown'")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for p in b.path:
                with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                    texts.append(f.read())
            yield b.assign(content=texts)

    found = known.select("path", "size_bytes", "k.category", "k.language").mapInPandas(read, "path string, size_bytes long, category string, language string, content string")
    return found.select("*", F.sha2("content", 256).alias("raw_hash"), F.sha2("content", 256).alias("content_hash"), paths.is_test(F.col("path")).alias("is_test"), paths.is_generated(F.col("path"), F.col("content")).alias("is_generated"))


def unindexed(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """Scanned files whose text isn't indexed yet."""
    live = indexed.where("not coalesce(is_deleted, false)").select("path", "raw_hash")
    return scanned.join(live, ["path", "raw_hash"], "left_anti")


def git(root: str, *args: str) -> str:
    """Output of a git command; empty if it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    return done.stdout.rstrip("\n") if done.returncode == 0 else ""


def changed_files(spark: SparkSession, root: str, base: str | None = None, staged: bool = False) -> DataFrame:
    """(path, status) of changed files; the working tree's state if nothing else is asked for and the diff is empty."""
    args = ["diff", "--name-status", *(["--cached"] if staged else []), *([base] if base else [])]
    rows = [(x.split("\t")[-1], x.split("\t")[0]) for x in git(root, *args).split("\n") if x]
    if not rows and not base and not staged:
        rows = porcelain(git(root, "status", "--porcelain"))
    return spark.createDataFrame(rows, "path string, status string")


def porcelain(output: str) -> list[tuple[str, str]]:
    """(path, status) of short status lines; a rename gives its new path."""
    return [(line[3:].split(" -> ")[-1].strip('"'), line[:2].strip() or "M") for line in output.split("\n") if len(line) > 3]


def patches(spark: SparkSession, root: str, base: str | None = None, staged: bool = False) -> DataFrame:
    """(patch_id, patch): the diff of the tree, one row."""
    text = git(root, "diff", *(["--cached"] if staged else []), *([base] if base else []))
    return spark.createDataFrame([(0, text)] if text else [], "patch_id long, patch string")


def commits(spark: SparkSession, root: str, limit: int = 5) -> DataFrame:
    """(commit, ts, subject) of the latest commits."""
    rows = [tuple(x.split("\x1f")) for x in git(root, "log", f"-{limit}", "--format=%h%x1f%ct%x1f%s").split("\n") if x]
    return spark.createDataFrame([(h, int(t), s) for h, t, s in rows], "commit string, ts long, subject string")


def branch(root: str) -> str:
    return git(root, "rev-parse", "--abbrev-ref", "HEAD") or "unknown"
