"""Queries of diffs, inferred edges, risk, migrations, stack traces and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import diffs, extract, inference, risk, store, traces
from codeloom.operators.checkpoints import cut
from codeloom.plans.registry import query
from codeloom.plans.text_queries import PATHS_SQL, part_paths
from codeloom.sources import testbed as tb
from codeloom.sources.testbed import EDGES_SQL, NODES_SQL, table

ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
SIGN = "case l_returnflag when 'A' then '+' when 'R' then '-' else ' ' end"
LINES_SQL = f"with l as (select l_orderkey as k, 'o' || l_orderkey || '.py' as file_path, {SIGN} as sign, row_number() over (partition by l_orderkey order by {ORDER}) as n, l_partkey as part from lineitem), d as (select *, cast(1 + coalesce(sum(case when sign = '-' then 0 else 1 end) over (partition by k order by n rows between unbounded preceding and 1 preceding), 0) as int) as new_line from l)"


def diff_lines(spark, sf_dir):
    """Every order as a patch of one file with one hunk; its items are the hunk's lines."""
    items = table(spark, sf_dir, "lineitem")
    held = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*ORDER.split(", "), F.expr(SIGN).alias("sign")))).alias("ls"))
    text = F.concat(F.array(F.concat(F.lit("+++ b/o"), F.col("l_orderkey").cast("string"), F.lit(".py")), F.lit("@@ -1 +1 @@")), F.transform("ls", lambda x: F.concat(x["sign"], x["l_partkey"].cast("string"))))
    return diffs.numbered(held.select(F.col("l_orderkey").alias("patch_id"), F.posexplode(text).alias("n", "line")))


@query(f"{LINES_SQL} select k as patch_id, file_path, sign || part as line, new_line from d")
def q_diff_lines(spark, sf_dir):
    return diff_lines(spark, sf_dir).where("not is_hunk").select("patch_id", "file_path", "line", "new_line")


@query(f"{LINES_SQL} select k as patch_id, file_path, count(*) filter (sign <> ' ') as changes, count(distinct case when sign <> ' ' then new_line end) as changed_lines from d group by 1, 2")
def q_hunks(spark, sf_dir):
    found = diffs.hunks(diff_lines(spark, sf_dir))
    return found.select("patch_id", "file_path", F.size("changed_lines").cast("long").alias("changes"), F.size(F.array_distinct("changed_lines")).cast("long").alias("changed_lines"))


@query(f"{LINES_SQL}, n as (select o_orderkey as k, part, a, b from orders, (values ('f', 1, 2), ('g', 3, 5)) v(part, a, b)) select d.k as patch_id, string_agg(distinct 'n' || d.k || n.part, ',' order by 'n' || d.k || n.part) as ids from d join n on n.k = d.k and d.new_line between a and b where sign <> ' ' group by d.k")
def q_hunk_nodes(spark, sf_dir):
    spans = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, a, b in (("f", 1, 2), ("g", 3, 5))]))
    key = F.col("o_orderkey").cast("string")
    nodes = table(spark, sf_dir, "orders").select(key.alias("key"), spans.alias("s")).select(F.concat(F.lit("n"), "key", "s.p").alias("id"), F.lit("function").alias("type"), F.concat(F.lit("o"), "key", F.lit(".py")).alias("file_path"), F.col("s.a").alias("line_start"), F.col("s.b").alias("line_end"))
    found = diffs.nodes_of_hunks(diffs.hunks(diff_lines(spark, sf_dir)), nodes)
    return found.select("patch_id", F.array_join("ids", ",").alias("ids"))


@query(f"{LINES_SQL} select file_path, count(*) filter (sign = '+') as added, count(*) filter (sign = '-') as removed from d group by 1")
def q_diff_summary(spark, sf_dir):
    return diffs.summary(diff_lines(spark, sf_dir))


@query("select e.event_id as probe, s.event_type || s.event_id as name from events e asof left join (select * from events where event_type in ('signup', 'error')) s on e.user_id = s.user_id and e.ts >= s.ts")
def q_asof_symbol(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("ts").alias("pos"), "event_id", "event_type")
    symbols = events.where("event_type in ('signup', 'error')").select("file", "pos", F.concat("event_type", F.col("event_id").cast("string")).alias("name"))
    return diffs.last_before(events.select("file", "pos", F.col("event_id").alias("probe")), symbols).select("probe", "name")


@query("with s as (select user_id as file, event_id as low, event_id + (event_id * 7) % 900 as high from events) select e.event_id as probe, 's' || max(s.low) as name from events e join s on s.file = e.user_id and e.event_id between s.low and s.high group by 1")
def q_innermost_span(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    spans = events.select(F.col("user_id").alias("file"), F.col("event_id").alias("low"), (F.col("event_id") + (F.col("event_id") * 7) % 900).alias("high"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("name"))
    return diffs.innermost(events.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), F.col("event_id").alias("probe")), spans)


SIGNALS = {
    "files": "count(distinct l_suppkey)", "nodes": "count(*) * 4", "impacted": "cast(sum(l_quantity) as bigint) % 30", "public_nodes": "count(*) % 2", "exported": "count(*)",
    "security_path": "l_orderkey % 7 = 0", "config_path": "l_orderkey % 5 = 0", "database_path": "l_orderkey % 11 = 0", "database_nodes": "l_orderkey % 2", "changed_lines": "cast(sum(l_quantity) as bigint)",
    "ambiguous": "l_orderkey % 3", "churn": "l_orderkey % 9", "tests": "l_orderkey % 4",
}
RISK_SQL = (
    "with s as (select l_orderkey, " + ", ".join(f"{v} as {k}" for k, v in SIGNALS.items()) + " from lineitem group by l_orderkey), r as (select l_orderkey, cast(least(100, case when files > 5 then 15 when files > 1 then 5 else 0 end + case when nodes > 20 then 15 when nodes > 5 then 8 else 0 end"
    " + case when impacted > 20 then 20 when impacted > 5 then 10 else 0 end + case when public_nodes > 0 then 15 else 0 end + least(12, 2 * exported) + case when security_path then 20 else 0 end + case when config_path then 10 else 0 end + case when database_path then 15 else 0 end"
    " + case when database_nodes > 0 then 15 else 0 end + case when changed_lines > 250 then 15 when changed_lines > 80 then 8 else 0 end + case when ambiguous > 0 then 8 else 0 end + case when churn > 5 then 8 else 0 end + case when tests = 0 then 10 else 0 end) as int) as risk from s)"
)


RISK_REASONS_SQL = """concat_ws('|', case when files > 5 then 'Change spans more than five files.' when files > 1 then 'Change spans multiple files.' end,
 case when nodes > 20 then 'Large number of changed graph nodes.' when nodes > 5 then 'Multiple changed symbols detected.' end,
 case when impacted > 20 then 'Broad blast radius through import/call dependents.' when impacted > 5 then 'Several dependent graph nodes may be impacted.' end,
 case when public_nodes > 0 then 'Public API, service, or schema nodes changed.' end, case when exported > 0 then 'Exported or public-looking symbols changed.' end,
 case when security_path then 'Security-sensitive file path changed.' end, case when config_path then 'Configuration or infrastructure file changed.' end,
 case when database_path then 'Database or schema-related file changed.' end, case when database_nodes > 0 then 'Database table or schema graph nodes changed.' end,
 case when changed_lines > 250 then 'Large diff with more than 250 changed lines.' when changed_lines > 80 then 'Moderate-size diff with more than 80 changed lines.' end,
 case when ambiguous > 0 then 'Some impacted dependencies are ambiguous parser facts.' end, case when churn > 5 then 'Changed area has recent git churn.' end,
 case when tests = 0 then 'No tests changed with this diff.' end)"""


@query(f"{RISK_SQL.replace('as risk from s', 'as risk, ' + RISK_REASONS_SQL + ' as reasons from s')} select l_orderkey, risk, case when risk >= 90 then 'critical' when risk >= 70 then 'high' when risk >= 35 then 'medium' else 'low' end as level, reasons from r")
def q_risk_score(spark, sf_dir):
    changes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.expr(v).alias(k) for k, v in SIGNALS.items()])
    return risk.score(changes).select("l_orderkey", "risk", "level", F.array_join("reasons", "|").alias("reasons"))


@query("""select 'web/r' || p_partkey || '.js' as file_path, m as name, cast(k as int) as line, 'module' as source from part, (values ('GET /parts/' , 1), ('POST /parts/', 3)) v(m0, k), lateral (select m0 || p_partkey as m)""")
def q_endpoint_nodes(spark, sf_dir):
    """Endpoints that the extractor finds in made-up sources, with the type of the node that routes to them."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("app.get('/parts/"), key, F.lit("', show)\n\nrouter.post('/parts/"), key, F.lit("', save)\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("web/r"), key, F.lit(".js")).alias("path"), F.lit("code").alias("category"), F.lit("javascript").alias("language"), text.alias("content"), F.sha2(text, 256).alias("content_hash"))
    found = cut(extract.facts(files))
    nodes, edges = extract.nodes(found), extract.edges(found).where("type = 'routes_to'")
    ends = nodes.where("type = 'api_endpoint'").select(F.col("id").alias("target_id"), "file_path", "name", F.col("line_start").alias("line"))
    return edges.select("source_id", "target_id").join(ends, "target_id").join(nodes.select(F.col("id").alias("source_id"), F.col("type").alias("source")), "source_id").select("file_path", "name", "line", "source")


STATEMENT = "case l_linenumber % 8 when 0 then 'DROP TABLE a;' when 1 then 'ALTER TABLE a drop column b;' when 2 then 'ALTER TABLE a ADD COLUMN c INT NOT NULL;' when 3 then 'ALTER TABLE a ADD COLUMN c INT NOT NULL DEFAULT 0;' when 4 then 'ALTER TABLE a ALTER COLUMN c TYPE BIGINT;' when 5 then 'ALTER TABLE a RENAME COLUMN c TO d;' when 6 then 'ALTER TABLE a ADD CONSTRAINT k FOREIGN KEY (c) REFERENCES b;' else 'SELECT 1;' end"


@query(f"select 'db/migrations/' || l_orderkey || '.sql' as path, case l_linenumber % 8 when 0 then 'drop_table' when 1 then 'drop_column' when 2 then 'add_not_null_no_default' when 4 then 'alter_column_type' when 5 then 'rename_column' else 'add_foreign_key' end as code, {STATEMENT} as snippet, count(*) as n from lineitem where l_returnflag <> 'R' and l_linenumber % 8 not in (3, 7) and l_orderkey % 3 <> 1 group by 1, 2, 3")
def q_migration(spark, sf_dir):
    signed = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(f"concat(case when l_returnflag = 'R' then '-' else '+' end, {STATEMENT})").alias("line"))
    path = F.when(F.col("l_orderkey") % 3 == 1, F.lit("src/plain.py")).otherwise(F.concat(F.lit("db/migrations/"), F.col("l_orderkey").cast("string"), F.lit(".sql")))
    patches = signed.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("patch")).select(path.alias("path"), "patch")
    return risk.migration_warnings(patches).groupBy("path", "code", "snippet").agg(F.count("*").alias("n"))


@query(f"{PATHS_SQL} select p_partkey, contains(path, 'token') as security, contains(path, '.env') or contains(path, '.github') or contains(path, 'docker') or contains(lower(path), 'docker') as config, contains(path, 'sql') as database from p")
def q_sensitive(spark, sf_dir):
    path = F.col("path")
    return part_paths(spark, sf_dir).select("p_partkey", risk.path_has(path, risk.SECURITY).alias("security"), risk.path_has(path, risk.CONFIG).alias("config"), risk.path_has(path, risk.DATABASE).alias("database"))


FRAME = """select event_id, 'src/u' || user_id || '.py' as file_path, cast(props->>'k' as int) as line, event_type as function from events"""


def issues(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    where = F.concat(F.lit('  File "./src/u'), F.col("user_id").cast("string"), F.lit('.py", line '), k, F.lit(", in "), F.col("event_type"))
    text = F.concat(F.lit("Traceback (most recent call last):\n"), where, F.lit("\n"), where, F.lit("\nValueError: bad "), k)
    return table(spark, sf_dir, "events").select("event_id", text.alias("issue"))


@query(f"select event_id, file_path, line, function, 'python' as language from ({FRAME})")
def q_stack_frames(spark, sf_dir):
    return traces.frames(issues(spark, sf_dir), "event_id").select("event_id", "file_path", "line", "function", "language")


@query("select event_id, 'ValueError' as type, 'bad ' || (props->>'k') as message from events")
def q_error_lines(spark, sf_dir):
    return traces.errors(issues(spark, sf_dir), "event_id")


@query(f"with f as ({FRAME}), u as (select distinct user_id from events), n as (select 'f' || user_id || ':' || a as id, 'src/u' || user_id || '.py' as file_path, a, a + 14 as b from u, generate_series(0, 80, 20) g(a)) select distinct n.id from n join f on f.file_path = n.file_path and f.line between n.a and n.b")
def q_frame_nodes(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u")).distinct()
    nodes = users.select("u", F.explode(F.sequence(F.lit(0), F.lit(80), F.lit(20))).alias("line_start")).select(F.concat(F.lit("f"), "u", F.lit(":"), F.col("line_start").cast("string")).alias("id"), F.lit("function").alias("type"), F.concat(F.lit("src/u"), "u", F.lit(".py")).alias("file_path"), "line_start", (F.col("line_start") + 14).alias("line_end"))
    return traces.nodes_of_frames(traces.frames(issues(spark, sf_dir), "event_id"), nodes).select("id")


SUBJECT = "split_part(p_name, ' ', 2)"


@query(f"""with s as (select p_brand as area, lower({SUBJECT}) as named, 's' || min(p_partkey) as id from part group by 1, 2), t as (select 't' || p_partkey as id, 'test_' || replace(p_name, ' ', '_') as name, p_brand || '/test_' || (p_partkey % 9) || '.py' as path, p_brand as area from part)
select s.id as source_id, t.id as target_id from s join t on s.area = t.area where length(named) >= 3 and (contains(replace(substr(lower(t.name), 6), '_', ''), named) or contains(lower(t.path), named))""")
def q_test_edges(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    subjects = part.groupBy("p_brand", F.expr(SUBJECT).alias("name")).agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("id"), F.lit("function").alias("type"), "name", F.concat("p_brand", F.lit("/code.py")).alias("file_path"))
    tests = part.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), F.lit("test").alias("type"), F.concat(F.lit("test_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), F.concat("p_brand", F.lit("/test_"), (F.col("p_partkey") % 9).cast("string"), F.lit(".py")).alias("file_path"))
    return inference.test_edges(subjects.unionByName(tests)).select("source_id", "target_id")


@query("select 's' || s_suppkey as source_id, 's' || (s_suppkey + 1) as target_id from supplier where s_suppkey + 1 in (select s_suppkey from supplier) and s_suppkey % 3 <> 2 union all select 's' || s_suppkey, 's1' from supplier where s_suppkey % 3 = 2 and s_suppkey <> 1")
def q_import_resolve(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    key = lambda c: F.concat(F.lit("s"), c.cast("string"))
    modules = s.select(key(F.col("s_suppkey")).alias("id"), F.concat(F.lit("pkg.s"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("qualified_name"))
    named = F.when(F.col("s_suppkey") % 3 == 2, F.lit("external::pkg/s1.ts")).otherwise(F.concat(F.lit("external::./s"), (F.col("s_suppkey") + 1).cast("string")))
    imports = s.select(key(F.col("s_suppkey")).alias("source_id"), F.lit("x").alias("target_id"), named.alias("imported"), F.concat(F.lit("pkg/s"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("source_file"))
    return inference.import_edges(imports, modules).select("source_id", "target_id")


@query("with d as (select l_orderkey as file, 'f' || l_linenumber as name, max(l_partkey) as callee from lineitem group by 1, 2) select distinct l_orderkey as file, l_suppkey as caller, d.callee from lineitem join d on d.file = l_orderkey and d.name = 'f' || (l_quantity::int % 7) where l_suppkey <> d.callee")
def q_resolved_calls(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    definitions = items.select(F.col("l_orderkey").alias("file"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_partkey").alias("line"), F.col("l_partkey").alias("id"))
    calls = items.select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("caller"), F.concat(F.lit("self.f"), (F.col("l_quantity").cast("int") % 7).cast("string")).alias("name"))
    return inference.resolved_calls(calls, definitions)


#: Frames of five grammars and a bare path, by user; each is what the pattern of its language reads.
GRAMMARS = (
    ("'  File \"a/u' || u || '.py\", line ' || k || ', in run'", "'a/u' || u || '.py'", "'run'", "'python'"),
    ("'    at load (web/u' || u || '.ts:' || k || ':7)'", "'web/u' || u || '.ts'", "'load'", "'node'"),
    ("'  at org.U' || u || '.go(U' || u || '.java:' || k || ')'", "'U' || u || '.java'", "'org.U' || u || '.go'", "'java'"),
    ("'  cmd/u' || u || '.go:' || k || ':3'", "'cmd/u' || u || '.go'", "null", "'go'"),
    ("'src/u' || u || '.rs:' || k", "'src/u' || u || '.rs'", "null", "'rust'"),
    ("'see lib/u' || u || '.tsx:' || k", "'lib/u' || u || '.tsx'", "null", "'unknown'"),
)


def _by_grammar(column: int) -> str:
    return "case u % 6 " + " ".join(f"when {n} then {g[column]}" for n, g in enumerate(GRAMMARS)) + " end"


@query(f"with e as (select event_id, user_id as u, cast(props->>'k' as int) as k from events) select event_id, cast(0 as int) as place, {_by_grammar(1)} as file_path, k as line, {_by_grammar(2)} as function, {_by_grammar(3)} as language from e")
def q_stack_grammars(spark, sf_dir):
    """Frames of every grammar, each said twice."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    issue = events.selectExpr("event_id", f"concat('Panic: x\n', {_by_grammar(0)}, '\n', {_by_grammar(0)}) as issue")
    return traces.frames(issue, "event_id")


FILED = f"with {NODES_SQL}, {EDGES_SQL}, gone as (select id from nodes where file_path = 'n3/customer.py')"


@query(f"{FILED} select id from edges where source_id not in (select id from gone) and target_id not in (select id from gone)")
def q_merge_replace(spark, sf_dir):
    path = spark.range(1).select(F.lit("n3/customer.py").alias("path"))
    nodes, edges = tb.nodes(spark, sf_dir), tb.edges(spark, sf_dir).withColumn("file_path", F.lit(None).cast("string"))
    return store.replace_files(nodes, edges, nodes.select("id", "file_path"), path)["edges"].select("id")


@query("select o_orderkey as k, cast(case when o_orderkey % 10 = 0 then 'new' else o_orderstatus end as varchar) as v from orders union all select -o_orderkey, 'added' from orders where o_orderkey % 100 = 0 and o_orderkey > 0")
def q_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    changed = orders.where("k % 10 = 0").select("k", F.lit("new").alias("v")).union(orders.where("k % 100 = 0 and k > 0").select((-F.col("k")).alias("k"), F.lit("added").alias("v")))
    return store.upsert(orders, changed, ["k"])


@query("select source || '/' || doc_id || '.' || lang as path, doc_id % 7 = 0 as is_deleted from documents")
def q_tombstone(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return store.tombstone(docs.select(path.alias("path"), F.lit(False).alias("is_deleted")), docs.where("doc_id % 7 = 0").select(path.alias("path")))


@query(f"with {NODES_SQL}, {EDGES_SQL} select id from nodes where file_path is null and id not in (select unnest([source_id, target_id]) from edges where type <> 'depends_on' and right(id, 1) in ('0', '1', '2', '3'))")
def q_orphans(spark, sf_dir):
    """Orders are orphans where no part is left that they read."""
    left = tb.edges(spark, sf_dir).where("type <> 'depends_on' and right(id, 1) in ('0', '1', '2', '3')")
    return store.orphans(tb.nodes(spark, sf_dir), left).select("id")
