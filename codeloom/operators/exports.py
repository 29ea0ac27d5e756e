"""The graph written for other tools. Writers are distributed except where a format is one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import safe_filename
from codeloom.operators.graph import last_per_pair


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each table; vectors stay out."""
    for name, df in tables.items():
        df.drop("vector").write.mode("overwrite").json(f"{path}/{name}")


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nodes under the typed headers of bulk loaders."""
    return nodes.select(F.col("id").alias("id:ID"), F.col("type").alias(":LABEL"), "name", "qualified_name", F.coalesce("file_path", F.lit("")).alias("file_path"))


def write_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges with the typed headers of bulk loaders of graph databases."""
    node_rows(nodes).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.select(F.col("source_id").alias(":START_ID"), F.col("target_id").alias(":END_ID"), F.col("type").alias(":TYPE")).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The elements of a GraphML document, one a row: parallel edges are one, ends without a node are bare nodes."""
    text = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    known = nodes.select(F.lit(0).alias("k"), F.concat(F.lit('<node id="'), text(F.col("id")), F.lit('"><data key="type">'), text(F.col("type")), F.lit('</data><data key="name">'), text(F.col("name")), F.lit("</data></node>")).alias("xml"))
    single = last_per_pair(edges)
    ends = single.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    bare = ends.select(F.lit(0).alias("k"), F.concat(F.lit('<node id="'), text(F.col("id")), F.lit('"/>')).alias("xml"))
    links = single.select(F.lit(1).alias("k"), F.concat(F.lit('<edge source="'), text(F.col("source_id")), F.lit('" target="'), text(F.col("target_id")), F.lit('"><data key="type">'), text(F.col("type")), F.lit("</data></edge>")).alias("xml"))
    return known.union(bare).union(links)


HEAD = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="all" attr.name="type" attr.type="string"/><key id="name" for="node" attr.name="name" attr.type="string"/><graph edgedefault="directed">'
TAIL = "</graph></graphml>"


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parts in order: head, nodes, edges, tail; their concatenation is the document."""
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(-1, HEAD), (2, TAIL)], "k int, xml string")
    graphml_rows(nodes, edges).unionByName(frame).repartitionByRange("k", "xml").sortWithinPartitions("k", "xml").select("xml").write.mode("overwrite").text(path)


def notes(nodes: DataFrame, limit: int = 500) -> DataFrame:
    """(name, content) of note files for the first nodes by qualified name; of equal names the last stays."""
    first = nodes.orderBy("qualified_name", "id").limit(limit)
    body = F.concat(F.lit("# "), "name", F.lit("\n\n- type: "), "type", F.lit("\n- file: "), F.coalesce("file_path", F.lit("")), F.lit("\n"))
    named = first.select(F.concat(safe_filename(F.col("qualified_name")), F.lit(".md")).alias("name"), "id", body.alias("content"))
    return named.groupBy("name").agg(F.max_by("content", "id").alias("content"))


