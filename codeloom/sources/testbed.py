"""The star-schema tables seen as a property graph, so that every operator runs on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.ids import edge_id, node_id
from codeloom.operators import graph

#: table, node type, key, name, file path, all as SQL both engines read.
VERTICES = (
    ("region", "domain", "r_regionkey", "r_name", "cast(null as string)"),
    ("nation", "module", "n_nationkey", "n_name", "concat(lower(n_name), '/nation.py')"),
    ("customer", "entity", "c_custkey", "c_name", "concat('n', cast(c_nationkey as string), '/customer.py')"),
    ("supplier", "service", "s_suppkey", "s_name", "concat('n', cast(s_nationkey as string), '/supplier.py')"),
    ("part", "resource", "p_partkey", "p_name", "concat(p_brand, '/part.py')"),
    ("orders", "flow", "o_orderkey", "cast(o_orderkey as string)", "cast(null as string)"),
)
TYPES = {t: kind for t, kind, *_ in VERTICES}
#: table, edge type, source table and key, target table and key.
LINKS = (
    ("nation", "contains", ("region", "n_regionkey"), ("nation", "n_nationkey")),
    ("customer", "belongs_to", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    ("supplier", "belongs_to", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
    ("orders", "depends_on", ("orders", "o_orderkey"), ("customer", "o_custkey")),
    ("lineitem", "reads_from", ("orders", "l_orderkey"), ("part", "l_partkey")),
    ("lineitem", "writes_to", ("supplier", "l_suppkey"), ("part", "l_partkey")),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(of: str, key: str):
    return node_id(F.lit(TYPES[of]), F.concat(F.lit(f"{of}::"), F.col(key).cast("string")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name, qualified_name, file_path, confidence_tier."""

    def one(of, kind, key, name, path):
        rows = table(spark, sf_dir, of)
        tier = F.when(F.col(key) % 5 == 0, "inferred").otherwise("extracted")
        return rows.select(_id(of, key).alias("id"), F.lit(kind).alias("type"), F.expr(name).alias("name"), F.concat(F.lit(f"{of}::"), F.col(key).cast("string")).alias("qualified_name"), F.expr(path).alias("file_path"), tier.alias("confidence_tier"))

    return reduce(DataFrame.unionByName, [one(*v) for v in VERTICES])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, target_id, type; line items are deduplicated by their keys before they are hashed."""

    def one(of, kind, source, target):
        pairs = table(spark, sf_dir, of).select(F.col(source[1]).alias("s"), F.col(target[1]).alias("t"))
        if of == "lineitem":
            pairs = graph.dealt(pairs, "s", "t").distinct()
        return pairs.select(_id(source[0], "s").alias("source_id"), _id(target[0], "t").alias("target_id"), F.lit(kind).alias("type"))

    found = reduce(DataFrame.unionByName, [one(*x) for x in LINKS])
    return found.select(edge_id(F.col("source_id"), F.col("target_id"), F.col("type"), F.lit("testbed")).alias("id"), "source_id", "target_id", "type")


def node_of(of: str, key: int) -> "F.Column":
    return node_id(F.lit(TYPES[of]), F.lit(f"{of}::{key}"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path, category, language, content, content_hash."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.lit("document").alias("category"), F.col("lang").alias("language"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"))


def _sql_id(of: str, key: str) -> str:
    return f"'{TYPES[of]}:' || left(sha256('{TYPES[of]}' || chr(31) || '{of}::' || {key}), 24)"


NODES_SQL = "nodes as (" + " union all ".join(
    f"select {_sql_id(of, key)} as id, '{kind}' as type, {name} as name, '{of}::' || {key} as qualified_name, {path} as file_path, case when {key} % 5 = 0 then 'inferred' else 'extracted' end as confidence_tier from {of}" for of, kind, key, name, path in VERTICES
) + ")"
EDGES_SQL = "edges as (select 'edge:' || left(sha256(source_id || chr(31) || target_id || chr(31) || type || chr(31) || 'testbed'), 24) as id, * from (" + " union all ".join(
    f"select {'distinct ' if of == 'lineitem' else ''}{_sql_id(*source)} as source_id, {_sql_id(*target)} as target_id, '{kind}' as type from {of}" for of, kind, source, target in LINKS
) + "))"


def sql_id(of: str, key: int | str) -> str:
    """SQL of a node's id; ``key`` is a number or a column."""
    return _sql_id(of, str(key))
