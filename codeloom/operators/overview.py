"""Counts and short lists over a whole graph: status, histograms, coverage, hot spots, a drawn view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many files and symbols onboarding lists, and types of symbols.
IMPORTANT_FILES, IMPORTANT_SYMBOLS = 20, 30
SYMBOL_TYPES = ("module", "class", "function", "service", "api_endpoint")
#: Fixed values of the drawn view: nodes, edges, places on a ring; and of hot spots.
VIEW_NODES, VIEW_EDGES, RING = 220, 500, 24
HOT_TYPES, HOT_WORDS, HOT = ("module", "service"), ("auth", "token", "secret", "payment"), 8


def status(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(DataFrame.crossJoin, counts)  # single rows


def freshness(files: DataFrame, at: str = "last_indexed_at") -> DataFrame:
    """(indexed_at): when the newest live file was indexed; null without any."""
    return files.where("not coalesce(is_deleted, false)").agg(F.max(at).alias("indexed_at"))


def languages(files: DataFrame, language: str = "language") -> DataFrame:
    """(language, files): live files by language."""
    live = files.where("not coalesce(is_deleted, false)") if "is_deleted" in files.columns else files
    return live.groupBy(F.coalesce(language, F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def coverage(nodes: DataFrame, known: tuple[str, ...] = ("document", "section")) -> DataFrame:
    """(nodes, coverage): how many percent of the nodes are of the given types."""
    share = F.try_divide(100.0 * F.count_if(F.col("type").isin(*known)), F.count("*"))
    return nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.round(share), F.lit(0)).cast("long").alias("coverage"))


def important_files(nodes: DataFrame, limit: int = IMPORTANT_FILES) -> DataFrame:
    """(file_path, n): files with the most nodes; ties by path."""
    return histogram(nodes.where("file_path is not null"), "file_path").orderBy(F.desc("n"), "file_path").limit(limit)


def files_with_counts(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, nodes): every file with how many nodes it has."""
    counted = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("nodes"))
    return files.select("path").join(counted, "path", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)).cast("long"))


def in_files(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of the files in ``paths`` (file_path)."""
    return nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(nodes.columns)


def exact(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with this very name, qualified name or path."""
    return nodes.where((F.col("qualified_name") == query) | (F.col("name") == query) | (F.coalesce("file_path", F.lit("")) == query))


def hot(column: str = "qualified_name", types: tuple[str, ...] = HOT_TYPES) -> Column:
    return F.col("type").isin(*types) | F.lower(column).rlike("|".join(HOT_WORDS))


def hotspots(nodes: DataFrame, limit: int = HOT, types: tuple[str, ...] = HOT_TYPES) -> DataFrame:
    """Nodes to watch: of some types, or with a telling word in their name."""
    return nodes.where(hot(types=types)).orderBy("qualified_name", "id").limit(limit)


def view(nodes: DataFrame, types: tuple[str, ...], limit: int = VIEW_NODES, ring: int = RING) -> DataFrame:
    """(id, ring, place): the first nodes of some types on rings, as they are drawn."""
    shown = nodes.where(F.col("type").isin(*types)).orderBy("id").limit(limit)
    ranked = shown.agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.posexplode("ids").alias("k", "id"))  # at most ``limit``
    return ranked.select("id", F.floor(F.col("k") / ring).cast("int").alias("ring"), (F.col("k") % ring).cast("int").alias("place"))


def view_edges(view_: DataFrame, edges: DataFrame, limit: int = VIEW_EDGES) -> DataFrame:
    """The first edges with both ends in a view."""
    ids = F.broadcast(view_.select("id"))  # at most VIEW_NODES
    both = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return both.select(edges.columns).orderBy("id").limit(limit)
