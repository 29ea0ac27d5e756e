"""The graph as versioned Parquet tables: merges write a new version, readers pin one.

A version is a directory ``v<number>`` with one folder a table; ``CURRENT`` names the newest
that is complete. Merges are anti-joins and unions, so no row is updated in place, and every
file system that Spark writes to will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.ids import stable_hash

TABLES = {
    "files": "path string, language string, category string, size_bytes long, content_hash string, raw_hash string, is_deleted boolean, is_generated boolean, is_test boolean",
    "nodes": "id string, type string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, summary string, tags array<string>, confidence double, confidence_tier string, content_hash string, metadata string",
    "edges": "id string, source_id string, target_id string, type string, confidence double, confidence_tier string, provenance_source string, file_path string, line int, metadata string",
    "chunks": "id string, file_path string, node_id string, kind string, content string, line_start int, line_end int, token_estimate int, content_hash string, metadata string",
    "embeddings": "entity_id string, entity_type string, provider string, model string, dimensions int, content_hash string, vector array<double>, text string, file_path string",
    "changes": "id string, file_path string, status string, changed_at timestamp, metadata string",
    "memories": "id string, kind string, content string, created_at timestamp, redacted boolean",
    "sessions": "id string, kind string, title string, summary string, created_at timestamp",
    "provenance": "id string, entity_id string, entity_type string, source string, source_path string, line_start int, line_end int, confidence_tier string, metadata string, created_at timestamp",
    "snapshots": "id string, name string, version long, created_at timestamp",
}
SCHEMA_VERSION = 1


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without a new row of their key, and the new rows; of new rows with one key the last by all columns. Columns that new rows lack are null."""
    whole = new.select(*[F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema])
    last = whole.groupBy(*key).agg(F.max(F.struct(*[c for c in old.columns if c not in key])).alias("_r")).select(*key, "_r.*").select(*old.columns)
    return old.join(new.select(*key).distinct(), key, "left_anti").select(old.columns).unionByName(last)


def replace_files(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, paths: DataFrame, new: dict[str, DataFrame] | None = None, keep_inbound: bool = False) -> dict[str, DataFrame]:
    """Drops what belongs to the files in ``paths`` (path) and adds ``new`` nodes, edges and chunks.

    Edges go by their file or by either end; with ``keep_inbound`` edges from other files stay
    where the node they point at comes back under the same id.
    """
    new = new or {}
    gone = paths.select(F.col("path").alias("file_path")).distinct()
    kept_nodes = nodes.join(gone, "file_path", "left_anti").select(nodes.columns)
    dropped = nodes.join(gone, "file_path", "left_semi").select("id")
    lost = dropped.join(new["nodes"].select("id"), "id", "left_anti") if keep_inbound and "nodes" in new else dropped
    kept_edges = edges.join(gone, "file_path", "left_anti").join(dropped.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(lost.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(edges.columns)
    kept_chunks = chunks.join(gone, "file_path", "left_anti").select(chunks.columns)
    kept = {"nodes": kept_nodes, "edges": kept_edges, "chunks": kept_chunks}
    return {name: upsert(df, new[name], ["id"]) if name in new else df for name, df in kept.items()}


def tombstone(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files with those in ``paths`` marked deleted."""
    marked = paths.select("path").distinct().withColumn("_gone", F.lit(True))
    return files.join(marked, "path", "left").withColumn("is_deleted", F.coalesce("_gone", "is_deleted")).select(files.columns)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a file that no edge touches any more."""
    used = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return nodes.where("file_path is null").join(used, "id", "left_anti")


def provenance(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Where each entity comes from: (entity_id, entity_type, source, source_path, line_start, line_end, confidence_tier, metadata)."""
    none = F.lit(None).cast("string").alias("metadata")
    return (
        nodes.select(F.col("id").alias("entity_id"), F.lit("node").alias("entity_type"), F.lit("extractor").alias("source"), F.col("file_path").alias("source_path"), "line_start", "line_end", "confidence_tier", none)
        .union(edges.select("id", F.lit("edge"), F.coalesce("provenance_source", F.lit("extractor")), "file_path", "line", "line", "confidence_tier", none))
        .union(chunks.select("id", F.lit("chunk"), F.lit("extractor"), "file_path", "line_start", "line_end", F.lit("extracted"), none))
    )


def merge_provenance(stored: DataFrame, said: DataFrame, order: str = "created_at") -> DataFrame:
    """Stored provenance with what is ``said`` now merged in, as if row after row by ``order``.

    A row is known by its entity, source and place. If it is there already, only its tier and metadata change; what
    it was first written with stays. Ties of the order go by all columns.
    """
    key = stable_hash(*[F.col(c) for c in ("entity_id", "source", "source_path", "line_start", "line_end")], length=24)
    rows = said.withColumn("id", F.concat(F.lit("provenance:"), key))
    first, last = ("entity_type", "created_at"), ("confidence_tier", "metadata")
    at = [F.col(order).alias("_at")]
    once = rows.groupBy("id", "entity_id", "source", "source_path", "line_start", "line_end").agg(F.min(F.struct(*at, *first)).alias("f"), F.max(F.struct(*at, *last)).alias("l"))
    new = once.select("id", "entity_id", "source", "source_path", "line_start", "line_end", *[F.col(f"f.{c}").alias(c) for c in first], *[F.col(f"l.{c}").alias(c) for c in last])
    old, now = stored.alias("o"), new.withColumn("_said", F.lit(True)).alias("n")
    columns = [c for c in stored.columns if c != "id"]
    value = lambda c: F.when(F.col("n._said"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in last else F.when(F.col("o.id").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return old.join(now, F.col("o.id") == F.col("n.id"), "full").select(F.coalesce("o.id", "n.id").alias("id"), *[value(c).alias(c) for c in columns])


def provenance_of(rows: DataFrame, entity: str, limit: int = 10) -> DataFrame:
    """The newest provenance of one entity; ties by id."""
    return rows.where(F.col("entity_id") == entity).orderBy(F.desc("created_at"), "id").limit(limit)


class Catalog:
    """Versioned tables under one root path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The newest complete version."""
        if not self._fs.exists(self._path(f"{self.root}/versions")):
            return None
        found = [int(s.getPath().getName()[1:]) for s in self._fs.listStatus(self._path(f"{self.root}/versions")) if self._fs.exists(self._path(f"{s.getPath()}/_COMPLETE"))]
        return max(found, default=None)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table; empty where the version lacks it."""
        at = self.version() if version is None else version
        path = f"{self.root}/versions/v{at}/{name}"
        if at is None or not self._fs.exists(self._path(path)):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes a new version: the given tables, and the others as they are; it counts once it is whole."""
        before = self.version()
        after = (before or 0) + 1
        for name in TABLES:
            df = tables[name] if name in tables else (self.read(name, before) if before is not None else None)
            if df is not None:
                wanted = self.spark.createDataFrame([], TABLES[name]).schema
                columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
                df.select(*columns).write.mode("overwrite").parquet(f"{self.root}/versions/v{after}/{name}")
        self._fs.create(self._path(f"{self.root}/versions/v{after}/_COMPLETE")).close()
        return after

    def append(self, name: str, rows: DataFrame) -> int:
        """A new version in which one of the logs has more rows."""
        old = self.read(name)
        return self.commit({name: old.unionByName(rows.select(old.columns))})
