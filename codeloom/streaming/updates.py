"""The graph as a log of micro-batches: each batch writes its own folder, and the newest batch of a file counts.

A micro-batch holds file events (path, status, content, category, language, content_hash, seq). Its folder
``<table>/batch=<id>`` is overwritten as a whole, so running a batch again after a failure changes nothing.
Nothing is rewritten: a change row for every event, a tombstone for every deleted file, and the facts of the touched
files only, their inferred edges included. Readers take the rows of each file's newest batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.ids import stable_hash
from codeloom.operators import chunking, extract, inference
from codeloom.operators.checkpoints import cut

EVENT = "path string, status string, content string, category string, language string, content_hash string, seq long"
#: Tables of the log and what is read where a log has none yet.
TABLES = {
    "files": "path string, status string, category string, language string, content_hash string, is_deleted boolean, batch long",
    "changes": "id string, path string, status string, seq long, batch long",
    "nodes": "id string, type string, name string, qualified_name string, file_path string, line_start int, line_end int, tags array<string>, metadata string, confidence_tier string, confidence double, batch long",
    "edges": "id string, source_id string, target_id string, type string, provenance_source string, file_path string, line int, confidence_tier string, batch long",
    "chunks": "id string, file_path string, kind string, line_start int, line_end int, content string, content_hash string, token_estimate int, batch long",
}


def is_deletion(status) -> "F.Column":
    return F.startswith(F.upper(status), F.lit("D"))


def last_events(batch: DataFrame) -> DataFrame:
    """The last event of each path; ties of ``seq`` go by all columns."""
    rest = [c for c in batch.columns if c not in ("path", "seq")]
    return batch.groupBy("path").agg(F.max(F.struct("seq", *rest)).alias("e")).select("path", *[f"e.{c}" for c in rest], "e.seq")


def log(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows of a table's log; empty if there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")


def newest(files: DataFrame) -> DataFrame:
    """Each file's newest row."""
    rest = [c for c in files.columns if c not in ("path", "batch")]
    return files.groupBy("path").agg(F.max(F.struct("batch", *rest)).alias("f")).select("path", *[f"f.{c}" for c in rest], "f.batch")


def live(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a log that belong to the newest batch of their file, if that isn't deleted; each id once."""
    at = newest(files).where("not is_deleted").select(F.col("path").alias("file_path"), "batch")
    return rows.join(at, ["file_path", "batch"], "left_semi").dropDuplicates(["id"])


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The merged state of a table. Nodes without a file, such as imported modules, stay as long as an edge of a live file touches them."""
    files = log(spark, root, "files")
    if table in ("files", "changes"):
        return newest(files) if table == "files" else log(spark, root, "changes")
    rows = log(spark, root, table)
    found = live(rows, files)
    if table != "nodes":
        return found
    used = live(log(spark, root, "edges"), files).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return found.unionByName(rows.where("file_path = ''").dropDuplicates(["id"]).join(used, "id", "left_semi"))


def _write(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    columns = [f.name for f in rows.sparkSession.createDataFrame([], TABLES[table]).schema if f.name != "batch"]
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns]).write.mode("overwrite").parquet(f"{root}/{table}/batch={batch_id}")


def updater(root: str, facts: Callable[[DataFrame], DataFrame] = extract.facts) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that merges one batch of file events into the log."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = cut(batch.select(*[c.split()[0] for c in EVENT.split(", ")]))
        last = last_events(events)
        gone = is_deletion(F.col("status"))
        key = F.concat(F.lit("change:"), stable_hash(F.lit(batch_id), F.col("path"), F.col("status"), F.col("seq"), length=24))
        _write(events.select(key.alias("id"), "path", "status", "seq").distinct(), root, "changes", batch_id)
        present = cut(last.where(~gone))
        found = cut(facts(present))
        nodes = cut(extract.nodes(found))
        spans = chunking.materialized(chunking.symbols(present.select("path", "content"), nodes)).withColumnRenamed("path", "file_path")
        # what was there before this batch, as a replay must not see its own rows
        before = log(spark, root, "files").where(F.col("batch") < batch_id)
        known = live(log(spark, root, "nodes").where(F.col("batch") < batch_id), before)
        others = known.join(last.select(F.col("path").alias("file_path")), "file_path", "left_anti")
        own = extract.edges(found)
        _write(nodes.withColumn("file_path", F.coalesce("file_path", F.lit(""))), root, "nodes", batch_id)
        _write(own.unionByName(touched_edges(nodes, others), allowMissingColumns=True), root, "edges", batch_id)
        _write(spans, root, "chunks", batch_id)
        _write(last.withColumn("is_deleted", gone), root, "files", batch_id)  # last: from here on the batch counts

    return run


def touched_edges(new: DataFrame, others: DataFrame) -> DataFrame:
    """Inferred edges with a touched file at either end: its tests against all subjects, and its subjects against all tests."""
    slim = ["id", "type", "name", "file_path"]
    mine, rest = new.select(*slim), others.select(*slim)
    tests, subjects = F.col("type") == "test", F.col("type") != "test"
    to_all = inference.test_edges(mine.where(tests).unionByName(mine.where(subjects)).unionByName(rest.where(subjects)))
    from_others = inference.test_edges(rest.where(tests).unionByName(mine.where(subjects)))
    found = to_all.unionByName(from_others).dropDuplicates(["id"])
    # an edge belongs to the touched file: that of the test, or else that of the subject
    at = mine.select(F.col("id").alias("target_id"), F.col("file_path").alias("_test"))
    of = mine.select(F.col("id").alias("source_id"), F.col("file_path").alias("_subject"))
    placed = found.join(at, "target_id", "left").join(of, "source_id", "left").withColumn("file_path", F.coalesce("_test", "_subject"))
    return placed.select("id", "source_id", "target_id", "type", "file_path", F.lit("test-convention").alias("provenance_source"), F.lit("inferred").alias("confidence_tier"))
