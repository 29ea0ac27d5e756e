"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.ids import edge_id, node_id
from codeloom.operators import exports, graph, overview
from codeloom.plans.registry import query
from codeloom.sources import testbed as tb
from codeloom.sources.testbed import EDGES_SQL, NODES_SQL, sql_id, table

GRAPH = f"with recursive {NODES_SQL}, {EDGES_SQL}"
BOTH = "both_ways as (select source_id as here, target_id as there from edges union select target_id, source_id from edges)"


def seeds(spark, *keys):
    return spark.range(1).select(F.explode(F.array(*[tb.node_of(*k) for k in keys])).alias("id"))


def hops(seed: str, links: str, depth: int) -> str:
    """CTEs h0..h<depth>: ids first reached at each hop."""
    out = [f"h0 as (select {seed} as id)"]
    for k in range(1, depth + 1):
        before = " union all ".join(f"select id from h{j}" for j in range(k))
        out.append(f"h{k} as (select distinct l.there as id from {links} l join h{k - 1} on l.here = h{k - 1}.id where l.there not in ({before}))")
    return ", ".join(out) + ", found as (" + " union all ".join(f"select id, {k} as hop from h{k}" for k in range(depth + 1)) + ")"


@query(f"{GRAPH} select id, qualified_name from nodes")
def q_ids_node(spark, sf_dir):
    return tb.nodes(spark, sf_dir).select("id", "qualified_name")


@query(f"{GRAPH} select id, type, count(*) as n from edges group by id, type")
def q_ids_edge(spark, sf_dir):
    return graph.dealt(tb.edges(spark, sf_dir), "id").groupBy("id", "type").agg(F.count("*").alias("n"))


@query(f"{GRAPH}, back as (select target_id as here, source_id as there from edges), {hops(sql_id('nation', 3), 'back', 2)} select n.id, n.type, n.qualified_name, cast(f.hop as int) as hop from found f join nodes n on n.id = f.id where f.hop > 0")
def q_impact(spark, sf_dir):
    found = graph.impacted(seeds(spark, ("nation", 3)), tb.edges(spark, sf_dir), tb.nodes(spark, sf_dir))
    return found.select("id", "type", "qualified_name", "hop")


@query(f"{GRAPH}, back as (select target_id as here, source_id as there from edges where type in ('depends_on', 'reads_from')), {hops(sql_id('customer', 7), 'back', 2)} select n.id, cast(f.hop as int) as hop from found f join nodes n on n.id = f.id where f.hop > 0")
def q_impact_by_type(spark, sf_dir):
    return graph.impacted(seeds(spark, ("customer", 7)), tb.edges(spark, sf_dir), tb.nodes(spark, sf_dir), types=("depends_on", "reads_from")).select("id", "hop")


@query(f"{GRAPH}, {BOTH}, {hops(sql_id('part', 11), 'both_ways', 1)} select n.id, n.type, cast(f.hop as int) as hop from found f join nodes n on n.id = f.id")
def q_neighborhood(spark, sf_dir):
    return graph.neighbourhood(seeds(spark, ("part", 11)), tb.edges(spark, sf_dir), tb.nodes(spark, sf_dir))[0].select("id", "type", "hop")


@query(f"{GRAPH} select id, source_id, target_id, type from edges where source_id = {sql_id('part', 11)} or target_id = {sql_id('part', 11)}")
def q_neighborhood_edges(spark, sf_dir):
    return graph.neighbourhood(seeds(spark, ("part", 11)), tb.edges(spark, sf_dir), tb.nodes(spark, sf_dir))[1].select("id", "source_id", "target_id", "type")


@query(f"{GRAPH}, {BOTH}, {hops(sql_id('supplier', 5), 'both_ways', 2)} select cast(hop as int) as hop, n.type, count(*) as n from found f join nodes n on n.id = f.id group by 1, 2")
def q_trace(spark, sf_dir):
    found = graph.neighbourhood(seeds(spark, ("supplier", 5)), tb.edges(spark, sf_dir), tb.nodes(spark, sf_dir), depth=2)[0]
    return found.groupBy("hop", "type").agg(F.count("*").alias("n"))


@query(f"{GRAPH}, {BOTH}, {hops(sql_id('region', 0), 'both_ways', 4)} select cast(min(hop) as int) as links from found where id = {sql_id('supplier', 2)}")
def q_path_len(spark, sf_dir):
    path = graph.shortest_path(seeds(spark, ("region", 0)), seeds(spark, ("supplier", 2)), tb.edges(spark, sf_dir))
    return path.agg(F.max("step").cast("int").alias("links"))


@query(f"{GRAPH}, keep as (select * from nodes where type in ('module', 'service') and qualified_name not like '%9') select e.id, e.type from edges e where source_id in (select id from keep) and target_id in (select id from keep)")
def q_induced(spark, sf_dir):
    keep = tb.nodes(spark, sf_dir).where("type in ('module', 'service') and qualified_name not like '%9'")
    return graph.induced(keep, tb.edges(spark, sf_dir)).select("id", "type")


@query(f"{GRAPH} select distinct n.id, n.qualified_name from edges e join nodes n on n.id = e.target_id where e.type = 'writes_to' and e.source_id in ({sql_id('supplier', 1)}, {sql_id('supplier', 2)})")
def q_tests_for_nodes(spark, sf_dir):
    return graph.tests_for(seeds(spark, ("supplier", 1), ("supplier", 2)), tb.edges(spark, sf_dir), tb.nodes(spark, sf_dir), kind="writes_to").select("id", "qualified_name")


@query(f"{GRAPH}, ends as (select id, source_id as node from edges union select id, target_id from edges), d as (select node, count(*) as n from ends group by node) select nodes.id, coalesce(d.n, 0) as degree from nodes left join d on d.node = nodes.id where type in ('resource', 'service', 'module')")
def q_degree(spark, sf_dir):
    return graph.degrees(tb.nodes(spark, sf_dir).where("type in ('resource', 'service', 'module')"), tb.edges(spark, sf_dir)).select("id", "degree")


@query(f"{GRAPH} select coalesce(file_path, type) as community, count(*) as size from nodes group by 1 order by size desc, community limit 10")
def q_communities(spark, sf_dir):
    return graph.communities(tb.nodes(spark, sf_dir))


@query(f"{GRAPH} select file_path, count(*) as n from nodes where file_path is not null group by 1 order by n desc, file_path limit 20")
def q_important_files(spark, sf_dir):
    return overview.important_files(tb.nodes(spark, sf_dir))


@query(f"{GRAPH} select e.id, a.name as source_name, e.type, b.name as target_name from edges e join nodes a on a.id = e.source_id join nodes b on b.id = e.target_id where e.type in ('contains', 'belongs_to', 'depends_on')")
def q_wiki_flows(spark, sf_dir):
    return graph.flow_rows(tb.edges(spark, sf_dir), tb.nodes(spark, sf_dir), ("contains", "belongs_to", "depends_on"))


@query(f"{GRAPH}, files as (select distinct file_path as path from nodes where type <> 'resource' and file_path is not null) select f.path, count(n.id) as nodes from files f left join nodes n on n.file_path = f.path and n.type = 'service' group by f.path")
def q_wiki_files(spark, sf_dir):
    nodes = tb.nodes(spark, sf_dir)
    files = nodes.where("type <> 'resource' and file_path is not null").select(F.col("file_path").alias("path")).distinct()
    return overview.files_with_counts(files, nodes.where("type = 'service'"))


@query(f"{GRAPH} select source_id, target_id, max(id) as id from edges group by 1, 2")
def q_graphml_edges(spark, sf_dir):
    return graph.last_per_pair(tb.edges(spark, sf_dir)).select("source_id", "target_id", "id")


@query(f"""{GRAPH} select id as "id:ID", type as ":LABEL", name, coalesce(file_path, '') as file_path from nodes""")
def q_export_nodes(spark, sf_dir):
    return exports.node_rows(tb.nodes(spark, sf_dir)).drop("qualified_name")


@query(f"{GRAPH} select (select count(*) from documents) as files, (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(*) from embeddings) as embeddings")
def q_status_counts(spark, sf_dir):
    return overview.status(files=table(spark, sf_dir, "documents"), nodes=tb.nodes(spark, sf_dir), edges=tb.edges(spark, sf_dir), embeddings=table(spark, sf_dir, "embeddings"))


@query("select coalesce(lang, 'unknown') as language, count(*) as files from documents group by 1")
def q_languages(spark, sf_dir):
    return overview.languages(table(spark, sf_dir, "documents"), "lang")


@query(f"{GRAPH} select type, confidence_tier, count(*) as n from nodes group by 1, 2")
def q_histograms(spark, sf_dir):
    return overview.histogram(tb.nodes(spark, sf_dir), "type", "confidence_tier")


@query(f"{GRAPH} select count(*) as nodes, cast(round(100.0 * count(*) filter (type in ('domain', 'module')) / count(*)) as bigint) as coverage from nodes")
def q_coverage(spark, sf_dir):
    return overview.coverage(tb.nodes(spark, sf_dir), ("domain", "module"))


@query(f"{GRAPH} select id, qualified_name from nodes where type in ('module', 'service') or regexp_matches(lower(qualified_name), 'auth|token|secret|payment') order by qualified_name, id limit 8")
def q_hotspots(spark, sf_dir):
    return overview.hotspots(tb.nodes(spark, sf_dir)).select("id", "qualified_name")


@query(f"{GRAPH}, shown as (select id, type from nodes where type in ('module', 'domain', 'service') order by id limit 220), ranked as (select id, type, row_number() over (order by id) - 1 as k from shown) select id, cast(k // 24 as int) as ring, cast(k % 24 as int) as place from ranked")
def q_graph_view(spark, sf_dir):
    return overview.view(tb.nodes(spark, sf_dir), ("module", "domain", "service"))


@query("select 'function:' || left(sha256('function' || chr(31) || p_name), 24) as id, 'edge:' || left(sha256(p_name || chr(31) || p_brand || chr(31) || 'None' || chr(31) || 'x'), 24) as edge from part")
def q_ids_null_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(node_id(F.lit("function"), F.col("p_name")).alias("id"), edge_id(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.lit("x")).alias("edge"))


@query(f"{GRAPH}, shown as (select id from nodes where type in ('module', 'domain', 'service') order by id limit 220) select id, type from edges where source_id in (select id from shown) and target_id in (select id from shown) order by id limit 500")
def q_graph_view_edges(spark, sf_dir):
    return overview.view_edges(overview.view(tb.nodes(spark, sf_dir), ("module", "domain", "service")), tb.edges(spark, sf_dir)).select("id", "type")


@query("select max(o_orderdate) as indexed_at from orders where o_orderstatus <> 'F'")
def q_freshness(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("last_indexed_at"), (F.col("o_orderstatus") == "F").alias("is_deleted"))
    return overview.freshness(files)
