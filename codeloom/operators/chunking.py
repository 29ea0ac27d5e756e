"""Spans of a text by line: fixed windows, sections, top-level keys, statements, symbols.

Each takes a frame with ``path`` and ``content`` and gives ``path, kind, line_start,
line_end, content``; contents are redacted and blank spans drop out. The lines of one file
are cut with array functions inside its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import chunk_id
from codeloom.functions.text import estimate_tokens, lines, redact_lines
from codeloom.operators import graph

WINDOW = 80
#: Files that one task joins with their symbols.
FILES = 1 << 16


def _spans(files: DataFrame, kind: str, starts: Column, ends: Column | None = None) -> DataFrame:
    """Rows for spans that begin at ``starts`` (1-based, sorted) and end before the next or at ``ends``."""
    last = F.greatest(F.size("ls"), F.lit(1))
    held = files.select("path", "ls", "safe", starts.alias("starts"), last.alias("last"), *([ends.alias("ends")] if ends is not None else []))
    to = F.col("ends") if ends is not None else F.transform("starts", lambda s, k: F.coalesce(F.get("starts", k + 1) - 1, F.col("last")))
    span = lambda a, b: F.struct(a.alias("line_start"), F.greatest(a, b).alias("line_end"))
    text = lambda r: F.array_join(F.slice("safe", r["line_start"], r["line_end"] - r["line_start"] + 1), "\n")
    cut = lambda r: F.struct(r["line_start"].alias("line_start"), r["line_end"].alias("line_end"), text(r).alias("content"))
    rows = held.select("path", F.explode(F.transform(F.zip_with("starts", to, span), cut)).alias("r")).select("path", "r.*")  # each line is copied once
    return rows.where(F.col("content").rlike(r"\S")).select("path", F.lit(kind).alias("kind"), "line_start", "line_end", "content")


def _lined(files: DataFrame) -> DataFrame:
    """Lines as they are, which say where spans begin, and redacted, which spans are made of."""
    return files.select("path", "content", lines(F.col("content")).alias("ls")).select("path", "ls", redact_lines(F.col("content"), F.col("ls")).alias("safe"))


def _where(test) -> Column:
    """Numbers of the lines that pass."""
    numbered = F.transform("ls", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n")))
    return F.transform(F.filter(numbered, lambda r: test(r["x"])), lambda r: r["n"])


def windows(files: DataFrame, size: int = WINDOW, kind: str = "text:window") -> DataFrame:
    return _spans(_lined(files), kind, F.sequence(F.lit(1), F.greatest(F.size("ls"), F.lit(1)), F.lit(size)))


def sections(files: DataFrame, preamble: bool = False) -> DataFrame:
    """Markdown sections; text before the first heading only with ``preamble``."""
    starts = _where(lambda x: x.rlike(r"^#{1,6}\s+.+$"))
    if preamble:
        starts = F.array_distinct(F.concat(F.array(F.lit(1)), starts))
    return _spans(_lined(files), "markdown:section", starts)


def keys(files: DataFrame) -> DataFrame:
    """Spans from one unindented ``key:`` or ``key=`` line to the next."""
    return _spans(_lined(files), "config:key", _where(lambda x: x.rlike(r"^[A-Za-z0-9_.-]+\s*[:=]")))


def statements(files: DataFrame) -> DataFrame:
    """Spans that end with each line that holds a semicolon, and what is left."""
    lined = _lined(files)
    ends = _where(lambda x: F.contains(x, F.lit(";")))
    size = F.greatest(F.size("ls"), F.lit(1))
    all_ends = F.when(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), ends), -1), F.lit(0)) < size, F.concat(ends, F.array(size))).otherwise(ends)
    cut = lined.withColumn("es", all_ends)
    starts = F.transform("es", lambda e, i: F.when(i == 0, F.lit(1)).otherwise(F.get("es", i - 1) + 1))
    return _spans(cut, "sql:statement", starts, F.col("es"))


def symbols(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One span for each symbol node with a line; files without any get windows."""
    # one join in tasks of bounded rows; files with and without symbols part after it
    n = files.count()
    named = nodes.where("line_start is not null and type in ('class', 'function', 'test', 'type', 'api_endpoint', 'database_table')")
    found = graph.dealt(named, "file_path", n=n, per_task=FILES).groupBy("file_path").agg(
        F.sort_array(F.collect_list(F.struct("line_start", F.greatest(F.col("line_end"), F.when(F.col("type") == "api_endpoint", F.col("line_start") + 8).otherwise(F.col("line_start"))).alias("line_end")))).alias("spans")
    )
    held = graph.dealt(files, "path", n=n, per_task=FILES).join(found, F.col("path") == F.col("file_path"), "left")
    size = F.greatest(F.size("ls"), F.lit(1))
    with_nodes = held.where("spans is not null")
    lined = with_nodes.select("path", "content", "spans", lines(F.col("content")).alias("ls")).select("path", "ls", redact_lines(F.col("content"), F.col("ls")).alias("safe"), "spans")
    cut = _spans(lined, "code:symbol", F.transform("spans", lambda s: F.least(s["line_start"], size)), F.transform("spans", lambda s: F.least(s["line_end"], size)))
    return cut.union(windows(held.where("spans is null").select(files.columns), kind="code:window"))


def materialized(spans: DataFrame) -> DataFrame:
    """Spans with id, hash and token estimate."""
    return spans.select(chunk_id(F.col("path"), F.col("line_start"), F.col("line_end"), F.col("content")).alias("id"), "*", F.sha2("content", 256).alias("content_hash"), estimate_tokens(F.col("content")).alias("token_estimate"))
