"""Queries of whole reviews, memories and wiki pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import lookups, memories, reports, review, store
from codeloom.plans.graph_queries import GRAPH
from codeloom.plans.registry import query
from codeloom.plans.text_queries import redact_sql
from codeloom.sources import testbed as tb
from codeloom.sources.testbed import table

#: Each nation is a change of four files. ``n`` is its key; patches as both engines write them.
PATHS = ("'n' || n || '/supplier.py'", "'n' || n || '/customer.py'", "'auth/token' || n || '.yml'", "'db/migrations/' || n || '.sql'")
PATCHES = (
    "case when n % 2 = 0 then '--- a/x' || chr(10) || '+++ b/n' || n || '/supplier.py' || chr(10) || '@@ -1,2 +5,3 @@' || chr(10) || ' same' || chr(10) || '+new' || chr(10) || '+new2' || chr(10) || '-old' end",
    "cast(null as string)",
    "case when n % 3 = 0 then '+++ b/auth/token' || n || '.yml' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+a: b' end",
    "'+++ b/db/migrations/' || n || '.sql' || chr(10) || '@@ -0,0 +1,2 @@' || chr(10) || '+DROP TABLE t' || n || ';' || chr(10) || '+SELECT 1;' || chr(10)",
)
#: Suppliers have lines, every seventh order is a test, and orders have files.
SEEN = (
    "id", "case when type = 'flow' and cast(name as bigint) % 7 = 0 then 'test' when type = 'entity' then 'class' else type end as type", "name", "qualified_name",
    "case when type = 'flow' then 'flows/' || cast(name as bigint) % 13 || '.py' else file_path end as file_path", "case when type = 'service' then cast(cast(split(qualified_name, '::')[{one}] as bigint) % 9 + 1 as int) end as line_start",
    "case when type = 'service' then cast(cast(split(qualified_name, '::')[{one}] as bigint) % 9 + 3 as int) end as line_end", "confidence_tier",
)


def _changes(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    rows = nations.select("n", F.posexplode(F.array(*[F.struct(F.expr(p).alias("path"), F.expr(d).alias("patch")) for p, d in zip(PATHS, PATCHES, strict=True)])).alias("place", "f"))
    return rows.select(F.col("n").alias("change"), "place", "f.path", "f.patch", (F.col("n") % 4).alias("commits"))


def _reviewed(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    nodes = tb.nodes(spark, sf_dir).selectExpr(*[c.format(one=1) for c in SEEN])
    return review.review(changes.select("change", "path", "place"), changes.select("change", "path", "patch"), changes.select("change", "path", "commits"), nodes, tb.edges(spark, sf_dir))


def _any(c: str, hints: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({c}), '{h}')" for h in hints) + ")"


def _joined(c: str, by: str | None = None) -> str:
    return f"coalesce(string_agg({c}, '|' order by {by or c}), '')"


FILES_SQL = " union all ".join(f"select n_nationkey as n, {k} as place, {p.replace(' n ', ' n_nationkey ')} as path, {d.replace(' n ', ' n_nationkey ').replace(' string)', ' varchar)')} as patch from nation" for k, (p, d) in enumerate(zip(PATHS, PATCHES, strict=True)))
SEEN_SQL = ", ".join(c.format(one=2) for c in SEEN)
POINTS = """least(100, 5 + case when nodes > 20 then 15 when nodes > 5 then 8 else 0 end + case when impacted > 20 then 20 when impacted > 5 then 10 else 0 end + case when public_nodes > 0 then 15 else 0 end + least(12, 2 * exported) + 20 + 15
 + case when changed_lines > 250 then 15 when changed_lines > 80 then 8 else 0 end + case when churn > 5 then 8 else 0 end + case when tests = 0 then 10 else 0 end)"""


@query(f"""{GRAPH}, f as ({FILES_SQL}), v as (select {SEEN_SQL} from nodes),
touched as (select n, path, unnest(case when place = 0 then [6, 7, 8] when place = 2 then [1] else [1, 2] end) as line from f where patch is not null),
symbols as (select distinct n, v.* from touched join v on v.file_path = path and line between line_start and line_end and type not in ('file', 'module')),
inside as (select f.n, v.*, f.place from f join v on v.file_path = f.path),
seeds as (select n, id, type, name, qualified_name, file_path, line_start from symbols union all select n, id, type, name, qualified_name, file_path, line_start from inside where n not in (select n from symbols)),
one as (select distinct s.n, e.source_id as id from seeds s join edges e on e.target_id = s.id where not exists (select 1 from seeds t where t.n = s.n and t.id = e.source_id)),
two as (select distinct o.n, e.source_id as id from one o join edges e on e.target_id = o.id where not exists (select 1 from seeds t where t.n = o.n and t.id = e.source_id) and not exists (select 1 from one t where t.n = o.n and t.id = e.source_id)),
hit as (select n, v.* from (from one union all from two) h join v on v.id = h.id),
tests as (select distinct n, coalesce(file_path, qualified_name) as test from (select n, type, file_path, qualified_name from inside union all select n, type, file_path, qualified_name from hit) where type = 'test'),
a as (select n, count(*) as nodes, count(*) filter (type in ('api_endpoint', 'service', 'schema')) as public_nodes, count(*) filter (type in ('class', 'function', 'type') and name not like '\\_%' escape '\\') as exported from seeds group by n),
b as (select n, count(*) as impacted from hit group by n), bf as (select n, {_joined("file_path")} as impacted_files from (select distinct n, file_path from hit where file_path is not null qualify dense_rank() over (partition by n order by file_path) <= {review.LISTED}) group by n),
c as (select n, count(*) as tests, {_joined("test")} as affected_tests from tests group by n),
d as (select n, count(*) as changed_lines from (select distinct * from touched) group by n),
s as (select n, {_joined("qualified_name", "coalesce(place, 10000), line_start, id")} as changed_symbols from (select y.*, f.place from symbols y left join f on f.n = y.n and f.path = y.file_path) group by n),
sec as (select n, {_joined("item")} as security_changes from (select n, path as item from f where {_any("path", lookups.SECURITY)} union select n, qualified_name from symbols where {_any("qualified_name", lookups.SECURITY)}) group by n),
pub as (select n, {_joined("item")} as public_changes from (select n, path as item from f where {_any("path", lookups.PUBLIC_PATHS)} union select n, qualified_name from symbols where type in ('api_endpoint', 'class', 'function', 'type') and name not like '\\_%' escape '\\') group by n),
ranked as (select s.n, s.id, s.qualified_name, row_number() over (partition by s.n order by coalesce(f.place, 10000), coalesce(s.line_start, 0), s.id) as k from seeds s left join f on f.n = s.n and f.path = s.file_path qualify k <= {review.FIRST_FLOWS}),
ends as (select id, source_id as here, target_id as other from edges union all select id, target_id, source_id from edges),
flow as (select r.n, r.k, r.qualified_name || ':' || (count(distinct case when other <> here then other end) + 1) || ':' || count(distinct ends.id) as said from ranked r join ends on ends.here = r.id group by r.n, r.k, r.qualified_name),
fl as (select n, {_joined("said", "k")} as flows from flow group by n),
z as (select n_nationkey as n, coalesce(nodes, 0) as nodes, coalesce(impacted, 0) as impacted, coalesce(tests, 0) as tests, coalesce(public_nodes, 0) as public_nodes, coalesce(exported, 0) as exported, changed_lines, cast(4 * (n_nationkey % 4) as int) as churn, coalesce(impacted_files, '') as impacted_files, coalesce(affected_tests, '') as affected_tests,
             coalesce(changed_symbols, '') as changed_symbols, security_changes, coalesce(public_changes, '') as public_changes, coalesce(flows, '') as flows
      from nation left join a on a.n = n_nationkey left join b on b.n = n_nationkey left join bf on bf.n = n_nationkey left join c on c.n = n_nationkey left join d on d.n = n_nationkey left join s on s.n = n_nationkey left join sec on sec.n = n_nationkey left join pub on pub.n = n_nationkey left join fl on fl.n = n_nationkey)
select n as change, nodes, impacted, tests, changed_lines, churn, impacted_files, affected_tests, changed_symbols, security_changes, public_changes, 'auth/token' || n || '.yml' as config_changes, 'db/migrations/' || n || '.sql' as database_changes, flows,
       'drop_table:DROP TABLE t' || n || ';' as migrations,
       'n' || n || '/supplier.py: ' || case when n % 2 = 0 then '+2/-1 lines in available diff.' else 'no git diff available; using graph/source context.' end || '|n' || n || '/customer.py: no git diff available; using graph/source context.|auth/token' || n || '.yml: ' || case when n % 3 = 0 then '+1/-0 lines in available diff.' else 'no git diff available; using graph/source context.' end || '|db/migrations/' || n || '.sql: +2/-0 lines in available diff.' as diff_summary,
       cast({POINTS} as int) as risk,
       'High-risk migration ops detected (drop_table). Stage, backfill, and verify rollback before merging.|' || '{lookups.PRIORITIES[0][1]}' || case when public_changes <> '' then '|{lookups.PRIORITIES[1][1]}' else '' end || '|{lookups.PRIORITIES[2][1]}|{lookups.PRIORITIES[3][1]}' || case when impacted_files <> '' then '|{lookups.PRIORITIES[4][1]}' else '' end || case when tests = 0 then '|{lookups.PRIORITIES[5][1]}' else '' end as priorities,
       '{"|".join(review.CHECKS)}|{review.CHECK_CONFIG}|{review.CHECK_AUTH}|{review.CHECK_TESTS}' as checklist,
       case when tests > 0 then '{review.RUN_TESTS}|' else '' end || 'explain n' || n || '/supplier.py|explain <changed-file-or-symbol>|handoff' as commands,
       '' as warnings, case when tests = 0 then '{review.NO_TESTS}' else '' end as missing from z""")
def q_review(spark, sf_dir):
    """The whole review of one change for each nation."""
    rows = _reviewed(spark, sf_dir)
    join = lambda c, name: F.array_join(c, "|").alias(name)
    flow = F.transform(F.coalesce("impacted_flows", F.array().cast("array<struct<k:int,entry:string,node_count:bigint,edge_count:bigint>>")), lambda f: F.concat_ws(":", f["entry"], f["node_count"].cast("string"), f["edge_count"].cast("string")))
    warned = F.transform("migration_warnings", lambda w: F.concat_ws(":", w["code"], w["snippet"]))
    return rows.select(
        "change", "nodes", "impacted", "tests", "changed_lines", "churn", join("impacted_files", "impacted_files"), join("affected_tests", "affected_tests"), join("changed_symbols", "changed_symbols"), join("security_sensitive_changes", "security_changes"),
        join("public_api_changes", "public_changes"), join("config_or_infra_changes", "config_changes"), join("database_or_schema_changes", "database_changes"), join(flow, "flows"), join(warned, "migrations"), join("diff_summary", "diff_summary"), "risk",
        join("prioritized_items", "priorities"), join("checklist", "checklist"), join("commands", "commands"), join("warnings", "warnings"), join("missing_tests", "missing"),
    )




SAID = "select case conv_id % 4 when 0 then 'decision' when 1 then 'task' when 2 then 'note' else 'rejected_attempt' end as kind, case when turn % 3 = 0 then 'api_key = ' || conv_id || chr(10) else '' end || coalesce(text, '') as content, turn, conv_id from conversations"
STAMP = "'2024-01-' || lpad(cast(1 + turn % 28 as varchar), 2, '0') || ' 00:00:00.000000'"
MEMORIES_SQL = f"with s as (select *, {STAMP} as stamp from ({SAID})), r as (select kind, {redact_sql('content')} as content, stamp from s), m as (select distinct 'memory:' || left(sha256(kind || chr(31) || content || chr(31) || stamp), 24) as id, kind, content, left(stamp, 10) as day from r)"


def _remembered(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ("decision", "task", "note", "rejected_attempt"))), (F.col("conv_id") % 4 + 1).cast("int"))
    content = F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("api_key = "), F.col("conv_id").cast("string"), F.lit("\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    at = F.make_timestamp(F.lit(2024), F.lit(1), (1 + F.col("turn") % 28).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    said = talks.select(kind.alias("kind"), content.alias("content"), at.alias("created_at"))
    return memories.remember(spark.createDataFrame([], store.TABLES["memories"]), said)


@query(f"{MEMORIES_SQL} select id, kind, sha256(content) as h, day from m where id not in (select id from m where kind = 'note' and day < '2024-01-03')")
def q_remember(spark, sf_dir):
    """Memories said twice and some forgotten: contents without secrets, ids by content and time."""
    rows = _remembered(spark, sf_dir)
    again = memories.remember(rows, rows.select("kind", "content", "created_at"))
    left = memories.forget(again, rows.where("kind = 'note' and created_at < timestamp '2024-01-03'").select("id"))
    return left.select("id", "kind", F.sha2("content", 256).alias("h"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(f"{MEMORIES_SQL} select id, kind from m where kind in ('decision', 'accepted_solution', 'task') order by day desc, id desc limit 50")
def q_memories_listed(spark, sf_dir):
    return memories.listed(_remembered(spark, sf_dir), (*memories.DECISIONS, *memories.TASKS)).select("id", "kind")


SAFE = "left(regexp_replace({c}, '[^\\pL\\pN_-]', '_', 'g'), 120)"


@query(f"""{GRAPH}, files as (select distinct file_path as path from nodes where file_path is not null and type <> 'entity'),
of_file as (select 'files/' || {SAFE.format(c="path")} as page, path, '# ' || path || chr(10) || chr(10) || '- Language: unknown' || chr(10) || '- Node count: ' || (select count(*) from nodes n where n.file_path = path) as text from files),
shown as (select * from nodes where type in ('module', 'class', 'function', 'test', 'api_endpoint', 'database_table', 'config') order by qualified_name, id limit {reports.SYMBOLS}),
of_symbol as (select 'symbols/' || {SAFE.format(c="qualified_name")} as page, qualified_name, '# ' || qualified_name || chr(10) || chr(10) || '- Type: ' || type || chr(10) || '- File: [[files/' || {SAFE.format(c="coalesce(file_path, 'external')")} || '|' || coalesce(file_path, 'external') || ']]' || chr(10) || '- Lines: None-None' || chr(10) || chr(10) || '## Backlinks' || chr(10) || '- [[architecture]]' as text from shown),
flow as (select e.id, '- `' || coalesce(a.qualified_name, e.source_id) || '` --' || e.type || '--> `' || coalesce(b.qualified_name, e.target_id) || '`' as line from (select * from edges where type in ('calls', 'routes_to', 'reads_from', 'writes_to', 'depends_on') order by id limit {reports.FLOWS}) e left join nodes a on a.id = e.source_id left join nodes b on b.id = e.target_id)
select page, max_by(text, path) as text from of_file group by page union all select page, max_by(text, qualified_name) from of_symbol group by page
union all select 'architecture', '# Architecture' || chr(10) || chr(10) || '## Key Symbols' || coalesce(string_agg(chr(10) || '- [[' || page || '|' || qualified_name || ']]', '' order by qualified_name), '') from of_symbol
union all select 'flows', '# Flows' || chr(10) || string_agg(chr(10) || line, '' order by id) from flow
union all select 'decisions', '# Decisions' || chr(10) union all select 'review', '# Review' || chr(10) || chr(10) || 'No review artifact generated yet.'""")
def q_wiki_pages(spark, sf_dir):
    """All pages of a wiki but the index."""
    nodes = tb.nodes(spark, sf_dir).withColumns({"line_start": F.lit(None).cast("int"), "line_end": F.lit(None).cast("int")})
    files = nodes.where("file_path is not null and type <> 'entity'").select(F.col("file_path").alias("path"), F.lit(None).cast("string").alias("language"), F.lit(False).alias("is_deleted")).distinct()
    return reports.wiki_pages(files, nodes, tb.edges(spark, sf_dir), spark.createDataFrame([], store.TABLES["memories"]))
