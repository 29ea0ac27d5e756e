"""Queries of lookups, review lists and lenses."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import lookups
from codeloom.plans.graph_queries import GRAPH, seeds
from codeloom.plans.registry import query
from codeloom.sources import testbed as tb
from codeloom.sources.testbed import sql_id, table

#: Customers as changed files and parts as changed symbols, in words both engines read.
PATH = "(case c_custkey % 6 when 0 then 'src/API/' when 1 then 'db/Migrations/' when 2 then 'auth/' when 3 then '.github/' when 4 then 'lib/jwt/' else 'docs/' end) || cast(c_custkey as string) || (case c_custkey % 4 when 0 then '.py' when 1 then '.yml' when 2 then '.tfvars' else '/Dockerfile' end)"
SYMBOL = (
    "case p_partkey % 5 when 0 then 'function' when 1 then 'schema' when 2 then 'api_endpoint' when 3 then 'class' else 'database_table' end as type",
    "(case when p_partkey % 3 = 0 then '_' else '' end) || p_name as name",
    "(case p_partkey % 4 when 0 then 'core' when 1 then 'Session' when 2 then 'jwt' else 'main' end) || '::' || cast(p_partkey as string) as qualified_name",
)
CHANGE = f"with f as (select {PATH} as path from customer), s as (select {', '.join(SYMBOL)} from part)"
CHUNKS = ("cast(l_orderkey as string) || '.py' as file_path", "case when l_linenumber = 2 then null else cast(l_linenumber as int) end as line_start", "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) as id")
FILES = ("o_orderpriority || '/' || cast(o_orderkey as string) as path", "case o_orderkey % 3 when 0 then 'document' when 1 then 'config' else 'infra' end as category", "o_orderstatus = 'F' as is_deleted")
LIVE = f"with files as (select {', '.join(FILES)} from orders)"


def _any(column: str, hints: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{h}')" for h in hints) + ")"


def _change(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(f"{PATH} as path"), table(spark, sf_dir, "part").selectExpr(*SYMBOL)


def _files(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*FILES)


@query(f"{CHANGE} select path as item from f where {_any('lower(path)', ('api', 'route', 'server', 'controller'))} union select qualified_name from s where type in ('api_endpoint', 'class', 'function', 'type') and name not like '\\_%' escape '\\'")
def q_public_changes(spark, sf_dir):
    return lookups.public_changes(*_change(spark, sf_dir))


@query(f"{CHANGE} select distinct path as item from f where regexp_matches(path, '(\\.(yml|yaml|toml|json|env|tf|tfvars)|Dockerfile)$') or {_any('lower(path)', ('docker', 'kubernetes', '.github', 'workflow', 'terraform'))}")
def q_config_changes(spark, sf_dir):
    return lookups.config_changes(_change(spark, sf_dir)[0])


@query(f"{CHANGE} select path as item from f where {_any('lower(path)', ('schema', 'migration', 'sql', 'database', 'prisma', 'alembic'))} union select qualified_name from s where type in ('database_table', 'schema')")
def q_database_changes(spark, sf_dir):
    return lookups.database_changes(*_change(spark, sf_dir))


WATCHED = ("auth", "token", "secret", "password", "permission", "crypto", "session", "jwt")


@query(f"{CHANGE} select path as item from f where {_any('lower(path)', WATCHED)} union select qualified_name from s where {_any('lower(qualified_name)', WATCHED)}")
def q_security_changes(spark, sf_dir):
    return lookups.security_changes(*_change(spark, sf_dir))


ASKED = " || ".join(f"case when s_suppkey % {k} = 0 then '{text}' || chr(10) else '' end" for k, (_, text) in zip((2, 3, 5, 7, 11, 13), lookups.PRIORITIES, strict=True))


@query(f"with a as (select s_suppkey as id, case s_nationkey % 4 when 0 then 'High-risk migration ops detected (drop_column, drop_table). Stage, backfill, and verify rollback before merging.' || chr(10) else '' end || {ASKED} as items from supplier) select id, case when items = '' then '{lookups.NO_PRIORITY}' else left(items, length(items) - 1) end as items from a")
def q_priorities(spark, sf_dir):
    flags = [(F.col("s_suppkey") % k == 0).alias(flag) for k, (flag, _) in zip((2, 3, 5, 7, 11, 13), lookups.PRIORITIES, strict=True)]
    high = F.when(F.col("s_nationkey") % 4 == 0, F.array(F.lit("drop_table"), F.lit("drop_column"), F.lit("drop_table")))
    found = lookups.priorities(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), high.alias("high"), *flags))
    return found.select("id", F.array_join("items", "\n").alias("items"))


@query(f"{GRAPH}, near as (select source_id as id, target_id as other, id as edge from edges union all select target_id, source_id, id from edges) select id, count(distinct case when other <> id then other end) + 1 as node_count, count(distinct edge) as edge_count from near where id in ({sql_id('supplier', 1)}, {sql_id('part', 11)}, {sql_id('nation', 3)}) group by id")
def q_impacted_flows(spark, sf_dir):
    return lookups.flow_counts(seeds(spark, ("supplier", 1), ("part", 11), ("nation", 3)), tb.edges(spark, sf_dir))


@query(f"{GRAPH} select id, type, name, qualified_name from nodes where id = {sql_id('part', 11)}")
def q_node_by_id(spark, sf_dir):
    nodes = tb.nodes(spark, sf_dir).join(seeds(spark, ("part", 11)), "id", "left_semi")
    key = seeds(spark, ("part", 11)).first().id
    return lookups.by_id(nodes, key).select("id", "type", "name", "qualified_name")


@query(f"with c as (select distinct {', '.join(CHUNKS)} from lineitem), r as (select *, cast(row_number() over (partition by file_path order by line_start nulls first, id) as int) as place from c) select file_path, id, place from r where place <= 3")
def q_chunks_for_file(spark, sf_dir):
    return lookups.first_chunks(table(spark, sf_dir, "lineitem").selectExpr(*CHUNKS).distinct(), 3).select("file_path", "id", "place")


@query("select o_orderkey as id from orders order by o_orderdate desc, o_orderkey desc limit 20")
def q_snapshots(spark, sf_dir):
    return lookups.newest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "o_orderdate", 20).select("id")


@query(f"{LIVE} select path from files where category = 'document' and not is_deleted")
def q_stale_docs(spark, sf_dir):
    return lookups.live_files(_files(spark, sf_dir), ("document",)).select("path")


@query(f"{LIVE} select path, category from files where category in ('config', 'infra') and not is_deleted order by path limit 25")
def q_related_configs(spark, sf_dir):
    return lookups.related_configs(_files(spark, sf_dir), seeds(spark, ("part", 11))).select("path", "category")


@query(f"{GRAPH} select 'node' as kind, id from (select id from nodes order by id limit 500) union all select 'edge', id from (select id from edges order by id limit 1000)")
def q_all_graph(spark, sf_dir):
    nodes, edges = lookups.sample_graph(tb.nodes(spark, sf_dir), tb.edges(spark, sf_dir))
    return nodes.select(F.lit("node").alias("kind"), "id").union(edges.select(F.lit("edge"), "id"))


@query(f"{GRAPH} select id, file_path from nodes where type in ('module', 'class', 'api_endpoint', 'config', 'document') and file_path <> '' order by id limit 8")
def q_read_first(spark, sf_dir):
    return lookups.read_first(tb.nodes(spark, sf_dir)).select("id", "file_path")


@query(f"{GRAPH}, e as (select * from edges where type in ('calls', 'routes_to', 'reads_from', 'writes_to', 'depends_on') order by id limit 24), named as (select id, qualified_name from nodes where type <> 'resource') select e.id, coalesce(a.qualified_name, e.source_id) as source, e.type, coalesce(b.qualified_name, e.target_id) as target from e left join named a on a.id = e.source_id left join named b on b.id = e.target_id")
def q_flow_lens(spark, sf_dir):
    return lookups.named_flows(tb.edges(spark, sf_dir), tb.nodes(spark, sf_dir).where("type <> 'resource'"))


@query("select cast(c_custkey as string) as path, o_orderstatus as status from customer left join (select o_custkey, min(o_orderstatus) as o_orderstatus from orders group by 1) on o_custkey = c_custkey")
def q_selected_changes(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.min("o_orderstatus").alias("status"))
    return lookups.selected_changes(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path")), changes)


@query(f"{GRAPH} select id, cast(case file_path when 'n9/supplier.py' then 1 when 'n2/supplier.py' then 2 when 'n5/supplier.py' then 3 else 10000 end as int) as place from nodes where type = 'service'")
def q_symbol_order(spark, sf_dir):
    services = tb.nodes(spark, sf_dir).where("type = 'service'").withColumn("line_start", F.lit(None).cast("int"))
    return lookups.in_file_order(services, ["n9/supplier.py", "n2/supplier.py", "n5/supplier.py"]).select("id", "place")


@query(f"{GRAPH} select file_path from nodes where type = 'service' and file_path is not null union select file_path from nodes where type = 'resource' and name like '%a%' and file_path is not null")
def q_pack_files(spark, sf_dir):
    nodes = tb.nodes(spark, sf_dir)
    return lookups.files_of(nodes.where("type = 'service'"), nodes.where("type = 'resource' and name like '%a%'"))


@query(f"{GRAPH} select id as entity_id, type || ' ' || name || ' ' || qualified_name || case when type = 'service' then ' sum one two said' else '' end as text from nodes where name <> ''")
def q_node_records(spark, sf_dir):
    service = F.col("type") == "service"
    rows = tb.nodes(spark, sf_dir).where("name <> ''").withColumns({"summary": F.when(service, "sum"), "tags": F.when(service, F.array(F.lit("one"), F.lit("two"))), "metadata": F.when(service, '{"a": "said", "b": 3, "c": true}')})
    return lookups.node_records(rows).select("entity_id", "text")


@query("select o_orderkey as id, case o_orderkey % 3 when 0 then 'fastapi' when 1 then 'django-or-flask' else 'fastapi-or-flask' end as framework from orders")
def q_python_framework(spark, sf_dir):
    method = F.element_at(F.array(F.lit("WEBSOCKET"), F.lit("ANY"), F.lit("GET")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), lookups.python_framework(method).alias("framework"))


@query("with f as (select p_brand || '/' || p_partkey as file_path, p_name || chr(10) || p_type as content from part) select 'chunk:' || left(sha256(file_path || chr(31) || '1' || chr(31) || '2' || chr(31) || sha256(content)), 24) as id, file_path, cast(2 as int) as line_end, sha256(content) as content_hash from f")
def q_whole_file_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.concat("p_name", F.lit("\n"), "p_type").alias("content"))
    return lookups.whole_files(files).select("id", "file_path", "line_end", "content_hash")


@query(f"{GRAPH}, c as (select cast(l_linenumber as string) || '-' || l_orderkey || '-' || l_suppkey as id, 'n' || s_nationkey || '/supplier.py' as file_path, case when l_linenumber = 1 then null else {sql_id('supplier', 'l_suppkey')} end as node_id from lineitem join supplier on s_suppkey = l_suppkey) select distinct c.id from c join nodes n on n.file_path = c.file_path and (c.node_id is null or c.node_id = n.id) where n.qualified_name = 'supplier::7'")
def q_node_detail(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    node = F.when(F.col("l_linenumber") != 1, tb._id("supplier", "l_suppkey"))
    chunks = items.select(F.concat_ws("-", "l_linenumber", "l_orderkey", "l_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/supplier.py")).alias("file_path"), node.alias("node_id"))
    return lookups.detail_chunks(tb.nodes(spark, sf_dir).where("qualified_name = 'supplier::7'"), chunks).select("id").distinct()
