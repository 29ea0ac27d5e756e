"""Queries of scans, text functions, chunking and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions import text as tx
from codeloom.operators import chunking, embeddings, memories, overview, routes, search
from codeloom.plans.registry import query
from codeloom.sources import scan
from codeloom.sources import testbed as tb
from codeloom.sources.testbed import NODES_SQL, table

#: Made-up paths over the part table, the same in both engines.
PATHS = "case p_partkey % 12 when 0 then 'src/' || p_partkey || '/main.py' when 1 then 'tests/t' || p_partkey || '.py' when 2 then 'k8s/app.yaml' when 3 then '.github/ci.yml' when 4 then 'web/x.spec.ts' when 5 then 'docs/a.md' when 6 then 'Dockerfile' when 7 then 'infra/main.tf' when 8 then 'a/.env' when 9 then 'dist/app.min.js' when 10 then 'node_modules/x/y.lock' else 'data/raw.bin' end"
PATHS_SQL = f"with p as (select p_partkey, p_name, {PATHS} as path from part)"


def part_paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(PATHS).alias("path"))


CLASSIFY_SQL = """case when path = 'Dockerfile' then 'infra' when path like '%.tf' then 'infra' when path like '.github/%' then 'infra' when path like 'k8s/%' then 'infra'
 when path like '%.py' or path like '%.ts' or path like '%.js' then 'code' when path like '%.md' then 'document' when path like '%.env' then 'config' else 'unknown' end"""
LANGUAGE_SQL = """case when path = 'Dockerfile' then 'dockerfile' when path like '%.tf' then 'terraform' when path like '.github/%' then 'github-actions' when path like 'k8s/%' then 'kubernetes'
 when path like '%.py' then 'python' when path like '%.ts' then 'typescript' when path like '%.js' then 'javascript' when path like '%.md' then 'markdown' when path like '%.env' then 'env' end"""


@query(f"{PATHS_SQL} select p_partkey, path, {CLASSIFY_SQL} as category, {LANGUAGE_SQL} as language from p")
def q_classify(spark, sf_dir):
    return part_paths(spark, sf_dir).withColumn("c", paths.classify(F.col("path"))).select("p_partkey", "path", "c.category", "c.language")


@query(f"{PATHS_SQL} select p_partkey, path like 'tests/%' or path like '%.spec.ts' as is_test, path like '%.min.js' as is_generated from p")
def q_is_test(spark, sf_dir):
    return part_paths(spark, sf_dir).select("p_partkey", paths.is_test(F.col("path")).alias("is_test"), paths.is_generated(F.col("path"), F.col("p_name")).alias("is_generated"))


@query(f"{PATHS_SQL} select p_partkey, path like 'dist/%' or path like 'node_modules/%' as ignored, path like 'src/%' or path like '%.md' as included from p")
def q_ignore(spark, sf_dir):
    return part_paths(spark, sf_dir).select("p_partkey", paths.ignored(F.col("path")).alias("ignored"), paths.included(F.col("path"), ("src/**", "*.md")).alias("included"))


@query("select p_partkey, lower(p_name) like 'test%' or lower(p_name) like '%test' or contains(lower(p_name), '.test') or contains(lower(p_name), '.spec') as is_test from part")
def q_is_test_symbol(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", paths.is_test_symbol(F.col("p_name")).alias("is_test"))


FILES_SQL = "with files as (select source || '/' || doc_id || '.' || lang as path, lang as language, text as content, sha256(text) as content_hash from documents)"
REDACT = "list_transform(string_split({t}, chr(10)), lambda l: case when regexp_matches(lower(l), 'api_key|apikey|secret|token|password|passwd|credential|private_key|access_key|refresh_token') then case when contains(l, '=') then trim(split_part(l, '=', 1)) || '=<redacted>' when contains(l, ':') then trim(split_part(l, ':', 1)) || ': <redacted>' else '<redacted secret-like line>' end else l end)"


def redact_sql(t: str) -> str:
    return f"array_to_string({REDACT.format(t=t)}, chr(10))"


@query(f"{FILES_SQL}, stored as (select * from files where not path like '%7.%') select f.path, f.content_hash from files f where not exists (select 1 from stored s where s.path = f.path and s.content_hash = f.content_hash)")
def q_skip_unchanged(spark, sf_dir):
    files = tb.files(spark, sf_dir).select("path", F.col("content_hash").alias("raw_hash"))
    stored = files.where("not path like '%7.%'").withColumn("is_deleted", F.lit(False))
    return scan.unindexed(files, stored).select("path", F.col("raw_hash").alias("content_hash"))


@query(f"{FILES_SQL} select path, sha256(case when content = '' then '' else {redact_sql("case when content like '%' || chr(10) then left(content, length(content) - 1) else content end")} end) as h from files")
def q_redact(spark, sf_dir):
    return tb.files(spark, sf_dir).select("path", F.sha2(tx.redact(F.col("content")), 256).alias("h"))


@query(f"{FILES_SQL} select path, cast(greatest(1, length(content) // 4) as int) as tokens, sha256(case when greatest(1, length(content) // 4) <= 700 then content else regexp_replace(left(content, 2800), '\\s+$', '') || chr(10) || chr(10) || '[trimmed to token budget]' end) as h from files")
def q_token_estimate(spark, sf_dir):
    return tb.files(spark, sf_dir).select("path", tx.estimate_tokens(F.col("content")).alias("tokens"), F.sha2(tx.trim_to_budget(F.col("content"), "tiny"), 256).alias("h"))


@query("""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line, unnest(string_split(text, chr(10))) as t from documents)
select doc_id, cast(line as int) as line, left(trim(t), 240) as text from l where regexp_matches(upper(t), 'TODO|FIXME') or t like 'The and%' order by doc_id, line limit 100""")
def q_todo_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "t"))
    hit = lines.where(F.upper("t").rlike("TODO|FIXME") | F.startswith("t", F.lit("The and")))
    return hit.select("doc_id", (F.col("k") + 1).alias("line"), F.left(F.trim("t"), F.lit(240)).alias("text")).orderBy("doc_id", "line").limit(100)


LINES_SQL = FILES_SQL + ", ls as (select path, case when content = '' then [] else string_split(case when content like '%' || chr(10) then left(content, length(content) - 1) else content end, chr(10)) end as l from files)"


def _files(spark, sf_dir):
    return tb.files(spark, sf_dir)


def spans_sql(spans: str) -> str:
    return f"{LINES_SQL}, spans as ({spans}) select path, cast(a as int) as line_start, cast(b as int) as line_end, sha256(t) as h from (select s.path, a, b, {redact_sql('array_to_string(l[a:b], chr(10))')} as t from spans s join ls on ls.path = s.path) where trim(regexp_replace(t, '\\s+', ' ', 'g')) <> ''"


def _hashed(spans):
    return spans.select("path", "line_start", "line_end", F.sha2("content", 256).alias("h"))


@query(spans_sql("select path, a, least(a + 9, len(l)) as b from (select path, l, unnest(generate_series(1, len(l), 10)) as a from ls)"))
def q_chunk_windows(spark, sf_dir):
    return _hashed(chunking.windows(_files(spark, sf_dir), size=10))


MARKED = "(select path, len(l) as n, generate_subscripts(l, 1) as k, unnest(l) as t from ls)"
DOC_LINES = "replace(replace(text, '\\nE', '\\n# E'), '. ', '; ')"


@query(spans_sql(f"select path, k as a, coalesce(lead(k) over (partition by path order by k) - 1, n) as b from {MARKED} where regexp_matches(t, '^[A-Za-z0-9_.-]+\\s*[:=]')").replace("text as content", "replace(text, chr(10) || 'T', chr(10) || 'key: T') as content"))
def q_chunk_keys(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\nT"), F.lit("\nkey: T")))
    return _hashed(chunking.keys(files))


@query(spans_sql(f"select path, k as a, coalesce(lead(k) over (partition by path order by k) - 1, n) as b from {MARKED} where regexp_matches(t, '^#{{1,6}}\\s+.+$')").replace("text as content", "replace(text, chr(10) || 'T', chr(10) || '# T') as content"))
def q_chunk_sections(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\nT"), F.lit("\n# T")))
    return _hashed(chunking.sections(files))


@query(spans_sql(f"select path, coalesce(lag(k) over (partition by path order by k), 0) + 1 as a, k as b from {MARKED} where contains(t, ';') or k = n").replace("text as content", "replace(text, 'on.', 'on;') as content"))
def q_chunk_statements(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("on."), F.lit("on;")))
    return _hashed(chunking.statements(files))


GRAPH = f"with {NODES_SQL}"
TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"{GRAPH} select id, name from nodes where qualified_name = 'nation::3' or name = 'nation::3' or file_path = 'nation::3'")
def q_find_exact(spark, sf_dir):
    return overview.exact(tb.nodes(spark, sf_dir), "nation::3").select("id", "name")


@query(f"{GRAPH} select id, file_path from nodes where file_path in ('n3/customer.py', 'n4/supplier.py')")
def q_nodes_for_files(spark, sf_dir):
    wanted = spark.range(1).select(F.explode(F.array(F.lit("n3/customer.py"), F.lit("n4/supplier.py"))).alias("file_path"))
    return overview.in_files(tb.nodes(spark, sf_dir), wanted).select("id", "file_path")


@query(f"{GRAPH} select id from nodes where contains(' ' || array_to_string({TOKENS.format(c='qualified_name')}, ' ') || ' ', ' nation 3 ') or list_contains({TOKENS.format(c='name')}, 'ring') or contains(' ' || array_to_string({TOKENS.format(c='name')}, ' ') || ' ', ' nation 3 ') or list_contains({TOKENS.format(c='qualified_name')}, 'ring')")
def q_fts_any(spark, sf_dir):
    return search.full_text(tb.nodes(spark, sf_dir), "nation_3 ring", ("name", "qualified_name")).select("id")


@query(f"{GRAPH} select id from nodes where contains(lower(qualified_name), 'ustomer::1') or contains(lower(name), 'ustomer::1')")
def q_fts_like_fallback(spark, sf_dir):
    return search.like(tb.nodes(spark, sf_dir), "ustomer::1", ("name", "qualified_name")).select("id")


@query(f"{GRAPH} select id, cast(src as int) as source from (select id, min(src) as src from (select id, 0 as src from nodes where name = 'nation' or qualified_name = 'nation' or coalesce(file_path, '') = 'nation' union all select id, 1 from nodes where list_contains({TOKENS.format(c='qualified_name')}, 'nation') or list_contains({TOKENS.format(c='name')}, 'nation')) group by id) order by src, id limit 20")
def q_find_nodes(spark, sf_dir):
    return search.find_nodes(tb.nodes(spark, sf_dir), "nation").select("id", "source")


@query(f"{GRAPH} select id, qualified_name from nodes order by case when contains(lower(qualified_name), 'supplier') then 2 else 0 end desc, case when confidence_tier = 'extracted' then 1 else 0 end desc, qualified_name desc limit 25")
def q_rank_nodes(spark, sf_dir):
    return search.rank_nodes(tb.nodes(spark, sf_dir), "Supplier").limit(25).select("id", "qualified_name")


COSINE = "round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 6)"


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


@query(f"select e.vec_id, {COSINE} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) > 0 order by list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) desc, e.vec_id limit 10")
def q_cosine_topk(spark, sf_dir):
    found = search.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"select e.vec_id, {COSINE} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.label % 2 = 0 and list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) > 0 order by list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) desc, e.vec_id limit 10")
def q_cosine_filtered(spark, sf_dir):
    found = search.nearest(table(spark, sf_dir, "embeddings").where("label % 2 = 0"), _query_vector(spark, sf_dir))
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"{GRAPH}, hits as (select 'node' as kind, id as key from nodes where list_contains({TOKENS.format(c='qualified_name')}, 'region') union all select 'chunk', cast(doc_id as varchar) from documents where list_contains(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), 'region') union all select 'vector', cast(vec_id as varchar) from (select e.vec_id from embeddings e, (select embedding from embeddings where vec_id = 0) q where list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) > 0 order by list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) desc, e.vec_id limit 10)) select kind, key from hits")
def q_hybrid(spark, sf_dir):
    nodes = search.full_text(tb.nodes(spark, sf_dir), "region", ("qualified_name",)).select(F.lit("node").alias("kind"), F.col("id").alias("key"))
    chunks = search.full_text(table(spark, sf_dir, "documents"), "region", ("text",)).select(F.lit("chunk").alias("kind"), F.col("doc_id").cast("string").alias("key"))
    vectors = search.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select(F.lit("vector").alias("kind"), F.col("vec_id").cast("string").alias("key"))
    return nodes.union(chunks).union(vectors)


@query()
def q_hash_embedding(spark, sf_dir):
    """All vectors by the 64-bit hash, which no SQL has; tests/operators/test_embeddings.py holds them against plain Python."""
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    return embeddings.LocalHash().vectors(records).select(F.col("entity_id").alias("doc_id"), "vector")


MEMORIES = "select conv_id || ':' || turn as id, role as kind, text as content, conv_id * 1000 + turn as created from conversations"


def _memories(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("kind"), F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created"))


@query(f"with m as ({MEMORIES}) select kind, count(*) as n, max(created) as newest from m group by kind")
def q_memories_by_kind(spark, sf_dir):
    return memories.by_kind(_memories(spark, sf_dir), "created")


@query(f"with m as ({MEMORIES}) select id, kind from m where lower(content) like '%thing%' or lower(kind) like '%thing%' or lower(content) like '%system%' or lower(kind) like '%system%' order by created desc, id desc limit 5")
def q_relevant_memories(spark, sf_dir):
    return search.relevant_memories(_memories(spark, sf_dir), "thing of System").select("id", "kind")


@query("with r as (select page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') as p from pages) select page_id, case when p like '%/' then rtrim(p, '/') else p end as route from (select page_id, regexp_replace(p, '[?#].*$', '') as p from r)")
def q_routes_pages(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", routes.normalized(path).alias("route"))


NEXT = "case p_partkey % 5 when 0 then 'web/app/(shop)/items/[id]/page.tsx' when 1 then 'pages/api/' || p_partkey || '.ts' when 2 then 'src/pages/index.js' when 3 then 'pages/_app.tsx' else 'app/page.css' end"


@query("select p_partkey, case p_partkey % 5 when 0 then 'GET' when 1 then 'ANY' else 'GET' end as method, case p_partkey % 5 when 0 then '/items/[id]' when 1 then '/api/' || p_partkey else '/' end as route from part where p_partkey % 5 in (0, 1, 2)")
def q_routes_next(spark, sf_dir):
    files = table(spark, sf_dir, "part").select("p_partkey", F.expr(NEXT).alias("path"), F.lit("").alias("content"))
    return routes.next_routes(files).select("p_partkey", "method", "route")


HTTP = "'app.get(\"/p/' || p_partkey || '\", f)' || chr(10) || 'x = 1' || chr(10) || 'Router.POST(''/q'', g)'"


@query("select p_partkey, 'GET' as method, '/p/' || p_partkey as route, 1 as line from part union all select p_partkey, 'POST', '/q', 3 from part")
def q_routes_http(spark, sf_dir):
    text = F.concat(F.lit('app.get("/p/'), F.col("p_partkey").cast("string"), F.lit("\", f)\nx = 1\nRouter.POST('/q', g)"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.lit("a.js").alias("path"), text.alias("content"))
    return routes.express_routes(files).select("p_partkey", "method", "route", "line")
