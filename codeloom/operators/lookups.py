"""Lookups and short lists over the graph's tables: details of an entity, lists of a review, lenses of a view.

Limits here are the feature (top lists); ties always go to the least id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.ids import chunk_id
from codeloom.functions.text import contains_any, estimate_tokens, redact
from codeloom.operators import graph, risk, search

#: What a review lists by parts of lower-case paths, ends of paths and types of symbols.
PUBLIC_PATHS = ("api", "route", "server", "controller")
PUBLIC_TYPES = ("api_endpoint", "class", "function", "type")
CONFIG_ENDS = (".yml", ".yaml", ".toml", ".json", ".env", ".tf", ".tfvars", "Dockerfile")
CONFIG_PATHS = ("docker", "kubernetes", ".github", "workflow", "terraform")
DATABASE_TYPES = ("database_table", "schema")
SECURITY = (*risk.SECURITY, "session", "jwt")
#: A flag of a review and what it asks for, in this order; the last stands alone.
PRIORITIES = (
    ("security", "Review authentication, authorization, secret handling, and audit logging first."),
    ("public_api", "Check public API compatibility, request/response contracts, and callers."),
    ("database", "Validate migrations, rollback behavior, and data-access callers."),
    ("config", "Validate environment, CI, deployment, and local developer defaults."),
    ("impacted_area", "Inspect impacted files with graph dependents before approving."),
    ("untested", "Add or update tests around changed symbols and impacted behavior."),
)
NO_PRIORITY = "Review changed symbols, run related tests, and verify context-pack uncertainty."
#: Types of nodes to read first, and of edges that are flows, in two views.
READ_FIRST = ("module", "class", "api_endpoint", "config", "document")
TOP_FLOWS = ("calls", "routes_to", "depends_on")
FLOWS = ("calls", "routes_to", "reads_from", "writes_to", "depends_on")


def by_id(rows: DataFrame, key: str, column: str = "id") -> DataFrame:
    """The row of one id."""
    return rows.where(F.col(column) == key).limit(1)


def first_chunks(chunks: DataFrame, limit: int) -> DataFrame:
    """The first chunks of every file by line, those without a line first."""
    order = Window.partitionBy("file_path").orderBy(F.col("line_start").asc_nulls_first(), "id")
    return chunks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def newest(rows: DataFrame, at: str, limit: int, key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(key)).limit(limit)


def live_files(files: DataFrame, categories: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """Files of some categories that aren't deleted, by path."""
    found = files.where(F.col("category").isin(*categories) & ~F.coalesce("is_deleted", F.lit(False))).orderBy("path")
    return found.limit(limit) if limit is not None else found


def related_configs(files: DataFrame, seeds: DataFrame, limit: int = 25) -> DataFrame:
    """Configuration files, if there is any seed at all."""
    return live_files(files, ("config", "infra"), 0 if seeds.isEmpty() else limit)


def sample_graph(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first nodes and twice as many edges; the edges needn't touch these nodes."""
    return nodes.orderBy("id").limit(limit), edges.orderBy("id").limit(2 * limit)


def _hits(files: DataFrame, symbols: DataFrame, in_path: Column, in_symbol: Column, by: tuple[str, ...]) -> DataFrame:
    return files.where(in_path).select(*by, F.col("path").alias("item")).union(symbols.where(in_symbol).select(*by, "qualified_name")).distinct()


def public_changes(files: DataFrame, symbols: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(item) beside the columns ``by``: changed paths and symbols that others may call."""
    return _hits(files, symbols, risk.path_has(F.col("path"), PUBLIC_PATHS), F.col("type").isin(*PUBLIC_TYPES) & ~F.startswith("name", F.lit("_")), by)


def config_changes(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    ends = reduce(lambda a, b: a | b, [F.endswith("path", F.lit(e)) for e in CONFIG_ENDS])
    return files.where(ends | risk.path_has(F.col("path"), CONFIG_PATHS)).select(*by, F.col("path").alias("item")).distinct()


def database_changes(files: DataFrame, symbols: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _hits(files, symbols, risk.path_has(F.col("path"), risk.DATABASE), F.col("type").isin(*DATABASE_TYPES), by)


def security_changes(files: DataFrame, symbols: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _hits(files, symbols, risk.path_has(F.col("path"), SECURITY), contains_any(F.lower("qualified_name"), SECURITY), by)


def priorities(reviews: DataFrame) -> DataFrame:
    """``items`` beside the flags: codes of high-risk statements (``high``, an array), then what each flag asks for."""
    codes = F.array_sort(F.array_distinct(F.coalesce("high", F.array().cast("array<string>"))))
    first = F.when(F.size(codes) > 0, F.concat(F.lit("High-risk migration ops detected ("), F.array_join(codes, ", "), F.lit("). Stage, backfill, and verify rollback before merging.")))
    items = F.array_compact(F.array(first, *[F.when(F.col(flag), text) for flag, text in PRIORITIES]))
    return reviews.withColumn("items", F.when(F.size(items) == 0, F.array(F.lit(NO_PRIORITY))).otherwise(items))


def flow_counts(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, node_count, edge_count) of each seed's neighbourhood, itself included; seeds without an edge drop out."""
    ends = edges.select("id", F.explode(F.array(F.struct(F.col("source_id").alias("at"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("at"), F.col("source_id").alias("other")))).alias("e")).select(F.col("id").alias("edge"), "e.*")
    near = ends.join(graph.near(seeds.select(F.col("id").alias("at")).distinct()), "at", "left_semi")
    others = F.count_distinct(F.when(F.col("other") != F.col("at"), F.col("other")))
    return near.groupBy(F.col("at").alias("id")).agg((others + 1).alias("node_count"), F.count_distinct("edge").alias("edge_count"))


def in_file_order(symbols: DataFrame, files: list[str]) -> DataFrame:
    """Symbols with their ``place`` in the order of the changed files, others last, then by line and id; each symbol once."""
    place = F.array_position(F.array(*[F.lit(f) for f in files]).cast("array<string>"), F.col("file_path"))
    known = F.when(F.coalesce(place, F.lit(0)) == 0, 10_000).otherwise(place)
    return symbols.dropDuplicates(["id"]).withColumn("place", known.cast("int")).orderBy("place", F.coalesce("line_start", F.lit(0)), "id")


def selected_changes(selected: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, status): every selected path, with its change where there is one."""
    return selected.select("path").distinct().join(changes.select("path", "status"), "path", "left")


def files_of(*found: DataFrame) -> DataFrame:
    """(file_path): files that any of several searches names, by path."""
    return reduce(DataFrame.union, [f.select("file_path") for f in found]).where("file_path is not null").distinct().orderBy("file_path")


def node_records(nodes: DataFrame) -> DataFrame:
    """(entity_id, entity_type, text, file_path): what of a node is embedded; ``tags`` and ``metadata`` (JSON) may be null."""
    values = F.map_values(F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>"))
    raw = F.map_values(F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,variant>"))
    said = F.transform(F.filter(F.arrays_zip(values.alias("v"), raw.alias("r")), lambda x: F.schema_of_variant(x["r"]) == "STRING"), lambda x: x["v"])
    parts = F.array(F.col("type"), F.col("name"), F.col("qualified_name"), F.col("summary"), F.array_join("tags", " "), F.array_join(said, " "))
    return nodes.select(F.col("id").alias("entity_id"), F.lit("node").alias("entity_type"), F.array_join(F.filter(parts, lambda p: F.length(p) > 0), " ").alias("text"), "file_path")


def chunk_records(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("entity_id"), F.lit("chunk").alias("entity_type"), F.col("content").alias("text"), "file_path")


def bullets(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, bullet) of the nodes that match a query best."""
    found = search.find_nodes(nodes, query, limit)
    return found.select("id", F.concat(F.lit("- "), "type", F.lit(" `"), "qualified_name", F.lit("`")).alias("bullet"))


def python_framework(method: Column) -> Column:
    return F.when(method == "WEBSOCKET", "fastapi").when(method == "ANY", "django-or-flask").otherwise("fastapi-or-flask")


def whole_files(files: DataFrame, kind: str = "source") -> DataFrame:
    """One chunk for each file (path, content), without secrets."""
    content = redact(F.coalesce("content", F.lit("")))
    lines = (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).cast("int")
    rows = files.select("path", content.alias("safe"), F.lit(1).alias("line_start"), F.coalesce(lines, F.lit(1)).alias("line_end"))
    return rows.select(chunk_id(F.col("path"), F.col("line_start"), F.col("line_end"), F.col("safe")).alias("id"), F.col("path").alias("file_path"), F.lit(kind).alias("kind"), F.col("safe").alias("content"), "line_start", "line_end", estimate_tokens(F.col("safe")).alias("token_estimate"), F.sha2("safe", 256).alias("content_hash"))


def read_first(nodes: DataFrame, limit: int = 8) -> DataFrame:
    return nodes.where(F.col("type").isin(*READ_FIRST) & (F.length("file_path") > 0)).orderBy("id").limit(limit)


def named_flows(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] = FLOWS, limit: int = 24) -> DataFrame:
    """(id, source, type, target) of the first edges of some types; an end that is no node is named by its id."""
    shown = edges.where(F.col("type").isin(*types)).orderBy("id").limit(limit)
    name = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("qualified_name").alias(side))
    both = shown.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left")
    return both.select("id", F.coalesce("source", "source_id").alias("source"), "type", F.coalesce("target", "target_id").alias("target"))


def detail_chunks(node: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of a node's file that are the node's or no node's."""
    here = node.select(F.col("id").alias("_id"), F.col("file_path").alias("_path"))
    return chunks.join(F.broadcast(here.limit(1)), F.expr("file_path = _path and (node_id is null or node_id = _id)"), "left_semi")
