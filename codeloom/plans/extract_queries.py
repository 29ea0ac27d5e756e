"""Queries of the extractor over made-up files, and of the log of updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.text import safe_filename, slug
from codeloom.operators import chunking, exports, extensions, extract, graph, lookups, routes, spans
from codeloom.operators.checkpoints import folder
from codeloom.plans.registry import query
from codeloom.sources import testbed as tb
from codeloom.sources.testbed import NODES_SQL, table
from codeloom.streaming import updates

#: Lines of a made-up file of nested classes, joined in both engines; ``k`` is the part's key.
NESTED = (
    "'class A' || k || ' {'",
    "'  function f' || k || '(x) {'",
    "case when k % 3 = 0 then '    if (x) { y' when k % 3 = 1 then '    go(x) {' else '    z' end",
    "case when k % 3 = 2 then '  }' else '  }}' end",
    "'  class B' || k || ' { m }'",
    "'  function one() { return 1 }'",
    "case when k % 2 = 0 then '}' else '' end",
    "'function late(' || k || ')'",
    "case when k % 5 = 0 then '{' when k % 5 = 1 then '  // note' else '  body' end",
    "case when k % 5 = 0 then '  in' else '' end",
    "case when k % 5 = 0 then '}' else '@mark' end",
    "'class Last' || k",
    "'    deep'",
    "case when k % 7 = 0 then '}' else '  deep' end",
)


def joined(lines: tuple[str, ...]) -> str:
    """The same text in either engine."""
    return " || chr(10) || ".join(f"({x})" for x in lines)


def _nested_sql() -> str:
    text = joined(NESTED)
    return f"""with p as (select p_partkey as k from part), f as (select k, string_split({text}, chr(10)) as ls from p),
l as (select k, generate_subscripts(ls, 1) as n, unnest(ls) as t, len(ls) as size from f),
m as (select *, length(t) - length(ltrim(t)) as ind, trim(t) as bare, contains(t, '{{') as opens,
             sum(length(t) - length(replace(t, '{{', '')) - (length(t) - length(replace(t, '}}', '')))) over (partition by k order by n) as depth,
             sum(cast(contains(t, '{{') as int)) over (partition by k order by n) as braces from l),
s as (select k, n, size, ind, 'class' as kind, regexp_extract(t, '\\bclass\\s+([A-Za-z_$][\\w$]*)', 1) as name, depth, braces,
             depth - (length(t) - length(replace(t, '{{', '')) - (length(t) - length(replace(t, '}}', '')))) as outside, braces - cast(opens as int) as before from m where regexp_matches(t, '\\bclass\\s+[A-Za-z_$]')
      union all
      select k, n, size, ind, 'function', regexp_extract(t, '\\bfunction\\s+([A-Za-z_$][\\w$]*)\\s*\\(', 1), depth, braces,
             depth - (length(t) - length(replace(t, '{{', '')) - (length(t) - length(replace(t, '}}', '')))), braces - cast(opens as int) from m where regexp_matches(t, '\\bfunction\\s+[A-Za-z_$][\\w$]*\\s*\\(')),
e as (select s.k, s.n, s.kind, s.name,
             coalesce(min(case when m.braces > s.before then case when m.depth <= s.outside then m.n end
                               when m.bare <> '' and m.ind <= s.ind and not regexp_matches(m.bare, '^(@|#|//)') then m.n end), 0) as at, any_value(s.size) as size, any_value(s.before) as before
      from s left join m on m.k = s.k and m.n > s.n group by s.k, s.n, s.kind, s.name),
z as (select e.k, e.n, e.kind, e.name, case when e.at = 0 then least(e.size, e.n + {spans.FALLBACK}) when m.braces > e.before then e.at else e.at - 1 end as last from e left join m on m.k = e.k and m.n = e.at)
select z.k, z.kind, z.name, cast(z.n as int) as line_start, cast(z.last as int) as line_end,
       (select max_by(c.name, c.n) from z c where c.k = z.k and c.kind = 'class' and c.n < z.n and c.last >= z.n) as owner from z"""


#: Made-up files of one task.
FILES = 1 << 16


def _made(spark, sf_dir, lines: tuple[str, ...], path: str, language: str, category: str = "code"):
    # a file of keys alone is small and read by few tasks; what is made of them is not
    parts = graph.dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k", per_task=FILES)
    return parts.selectExpr("k", f"{path} as path", f"{joined(lines)} as content").withColumns({"language": F.lit(language), "category": F.lit(category)})


@query(_nested_sql())
def q_symbol_spans(spark, sf_dir):
    """Ends and enclosing classes of the symbols of nested files."""
    files = _made(spark, sf_dir, NESTED, "'src/' || k || '.ts'", "typescript")
    symbols = F.array_sort(F.array_distinct(extract._by_language(extract.SYMBOLS, extract._named)), lambda a, b: F.when(a["line"] != b["line"], a["line"] - b["line"]).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0))
    rows = files.select("k", F.split("content", "\n", -1).alias("ls"), symbols.alias("ss"))
    each = rows.select("k", "ss", F.explode(F.arrays_zip(F.col("ss").alias("s"), spans.spans(F.col("ls"), F.col("ss")).alias("at"))).alias("z"))
    owner = F.get(F.transform("ss", lambda s: s["name"]), F.when(F.col("z.at.owner") >= 0, F.col("z.at.owner")))
    return each.select("k", "z.s.kind", "z.s.name", F.col("z.s.line").alias("line_start"), F.col("z.at.end").alias("line_end"), owner.alias("owner"))


#: A made-up Go file with two blocks, where one quoted line stands in code and in a block.
GO = (
    "'package p' || k",
    "'import \"solo' || k || '\"'",
    "'import ('",
    "'  \"fmt\"'",
    "case when k % 2 = 0 then '  alias \"a/b\" // \"c\"' else '' end",
    "')'",
    "'func f() {'",
    "'  \"fmt\"'",
    "'  x := \"text\"'",
    "case when k % 4 = 1 then ' )' else '}' end",
    "'import ('",
    "'  \"second/' || k || '\"'",
    "case when k % 3 = 0 then '  )' else '' end",
    "'  \"fmt\"'",
    "')'",
    "'var y = \"import \"'",
)


@query(f"""with p as (select p_partkey as k from part), f as (select k, string_split({joined(GO)}, chr(10)) as ls from p),
l as (select k, generate_subscripts(ls, 1) as n, trim(unnest(ls)) as t from f),
m as (select *, case when starts_with(t, 'import (') then 1 when t = ')' then 0 end as mark from l),
b as (select *, coalesce(last_value(mark ignore nulls) over (partition by k order by n rows between unbounded preceding and 1 preceding), 0) as inside from m),
r as (select k, n, t from b where not starts_with(t, 'import (') and not (inside = 1 and t = ')') and (inside = 1 or starts_with(t, 'import ')))
select k, unnest(regexp_extract_all(t, '"([^"]+)"', 1)) as name, cast(n as int) as line from r""")
def q_go_imports(spark, sf_dir):
    files = _made(spark, sf_dir, GO, "'p' || k || '.go'", "go")
    found = files.select("k", F.explode(extract.go_imports(F.split("content", "\n", -1))).alias("i"))
    return found.select("k", "i.name", "i.line")


class Makefile:
    """Targets of a makefile as functions: a language that comes from outside."""

    def eval(self, path: str, content: str):
        lines = (content or "").split("\n")
        starts = [k for k, x in enumerate(lines) if x[:1].isalpha() and ":" in x and ":=" not in x]
        for at, after in zip(starts, [*starts[1:], len(lines)], strict=True):
            yield "function", lines[at].split(":")[0].strip(), None, at + 1, after


MAKE = ("'build' || k || ': deps'", "'\tcc x'", "'X := 1'", "case when k % 2 = 0 then 'test: build' else '# none' end", "'\tgo'")


@query("""select 'm/' || p_partkey || '.mk' as path, 'build' || p_partkey as name, 'm/' || p_partkey || '.mk::build' || p_partkey as qualified_name, 1 as line_start, case when p_partkey % 2 = 0 then 3 else 5 end as line_end from part
union all select 'm/' || p_partkey || '.mk', 'test', 'm/' || p_partkey || '.mk::test', 4, 5 from part where p_partkey % 2 = 0""")
def q_extension_nodes(spark, sf_dir):
    """Nodes of a language that a registered table function reads."""
    registry = extensions.Registry(spark)
    registry.register("makefile", Makefile)
    files = _made(spark, sf_dir, MAKE, "'m/' || k || '.mk'", "makefile").withColumn("content_hash", F.lit(""))
    return registry.facts(files).select("path", "name", "qualified_name", "line_start", "line_end")


#: Made-up files by kind: path, category, language, text; and what is read out of them: (fact, type, name, first line, last line, source, target).
MADE = {
    "ts": ("'web/s' || k || '.ts'", "code", "typescript", "import { h } from './util'\nexport class Box {\n}\nconst run = (a) => {\n  h(a)\n}\nfunction start() {\n  run(1)\n}\nfunction testAll() {\n}\n"),
    "rs": ("'lib/s' || k || '.rs'", "code", "rust", "use std::io;\npub fn go() {\n  other()\n}\nfn other() {\n}\npub struct Thing {\n}\n"),
    "java": ("'j/S' || k || '.java'", "code", "java", "import java.util.List;\npublic class Main {\n  public void run(int x) {\n  }\n}\n"),
    "rb": ("'r/s' || k || '.rb'", "code", "ruby", "require 'json'\nclass Dog\n  def bark!\n    1\n  end\nend\n"),
    "php": ("'p/s' || k || '.php'", "code", "php", "use App\\Models;\nclass Cat {\n  function purr() {\n  }\n}\n"),
    "sh": ("'b/s' || k || '.sh'", "code", "bash", "source ./env\nbuild() {\n  x\n}\n"),
    "py": ("'a/s' || k || '.py'", "code", "python", "import os\nfrom db import users\n\nclass Auth(Base):\n    def login(self):\n        return check(1)\n\n\ndef check(x):\n    return x\n"),
    "sql": ("'d/s' || k || '.sql'", "code", "sql", "CREATE TABLE users (id INT);\nSELECT * FROM users JOIN roles ON 1=1;\n"),
    "md": ("'doc/s' || k || '.md'", "document", "markdown", "# Title\n\ntext\n\n## Part\n\n## Part\n"),
    "rst": ("'doc/s' || k || '.rst'", "document", "rst", "Title\n=====\n\ntext\n"),
    "json": ("'c/s' || k || '.json'", "config", "json", '{"b": 1, "a": 2}'),
    "tf": ("'i/s' || k || '.tf'", "infra", "terraform", 'resource "aws" "web" {\n}\nmodule "net" {\n}\n'),
}
FOUND = {
    "ts": (
        ("node", "module", "s{k}", 1, 12, None, None), ("node", "class", "Box", 2, 3, None, None), ("node", "function", "run", 4, 6, None, None), ("node", "function", "start", 7, 9, None, None), ("node", "test", "testAll", 10, 11, None, None),
        ("import", None, None, 1, None, "web.s{k}.ts", "./util"), ("call", "function", None, 8, None, "web.s{k}.ts::start", "web.s{k}.ts::run"),
    ),
    "rs": (("node", "module", "s{k}", 1, 9, None, None), ("node", "function", "go", 2, 4, None, None), ("node", "function", "other", 5, 6, None, None), ("node", "type", "Thing", 7, 8, None, None), ("import", None, None, 1, None, "lib.s{k}.rs", "std::io"), ("call", "function", None, 3, None, "lib.s{k}.rs::go", "lib.s{k}.rs::other")),
    "java": (("node", "module", "S{k}", 1, 6, None, None), ("node", "class", "Main", 2, 5, None, None), ("node", "function", "run", 3, 4, None, None), ("import", None, None, 1, None, "j.S{k}.java", "java.util.List")),
    "rb": (("node", "module", "s{k}", 1, 7, None, None), ("node", "class", "Dog", 2, 5, None, None), ("node", "function", "bark!", 3, 4, None, None), ("import", None, None, 1, None, "r.s{k}.rb", "json")),
    "php": (("node", "module", "s{k}", 1, 6, None, None), ("node", "class", "Cat", 2, 5, None, None), ("node", "function", "purr", 3, 4, None, None), ("import", None, None, 1, None, "p.s{k}.php", "App\\Models")),
    "sh": (("node", "module", "s{k}", 1, 5, None, None), ("node", "function", "build", 2, 4, None, None), ("import", None, None, 1, None, "b.s{k}.sh", "./env")),
    "py": (
        ("node", "module", "s{k}", 1, 11, None, None), ("node", "class", "Auth", 4, 6, None, None), ("node", "function", "login", 5, 6, None, None), ("node", "function", "check", 9, 10, None, None), ("import", None, None, 1, None, "a.s{k}", "os"), ("import", None, None, 2, None, "a.s{k}", "db"),
        ("inherit", "class", None, 4, None, "a.s{k}.Auth", "Base"), ("call", "function", None, 6, None, "a.s{k}.Auth.login", "a.s{k}.check"),
    ),
    "sql": (("table", "writes_to", "users", 1, None, None, "database::users"), ("table", "reads_from", "users", 2, None, None, "database::users"), ("table", "reads_from", "roles", 2, None, None, "database::roles")),
    "md": (("node", "document", "s{k}.md", 1, None, None, None), ("section", "section", "Title", 1, 1, None, None), ("section", "section", "Part", 5, 5, None, None), ("section", "section", "Part", 7, 7, None, None)),
    "rst": (("node", "document", "s{k}.rst", 1, None, None, None), ("section", "section", "Title", 1, 1, None, None)),
    "json": (("node", "config", "s{k}.json", 1, None, None, None),),
    "tf": (("node", "resource", "s{k}.tf", 1, None, None, None), ("section", "resource", "resource.aws.web", 1, 1, None, None), ("section", "resource", "module.net", 3, 3, None, None)),
}


def _found_sql() -> str:
    def value(v) -> str:
        return "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("{k}", "' || k || '") + "'"

    rows = [f"select k, {n} as place, " + ", ".join(f"{value(v)} as {c}" for c, v in zip(("fact", "type", "name", "line_start", "line_end", "source", "target"), row, strict=True)) + f" from p where k % {len(MADE)} = {n}" for n, kind in enumerate(MADE) for row in FOUND[kind]]
    casts = "cast(type as varchar) as type, cast(name as varchar) as name, cast(line_start as int) as line_start, cast(line_end as int) as line_end, cast(source as varchar) as source, cast(target as varchar) as target"
    return f"with p as (select p_partkey as k from part) select k, fact, {casts} from (" + " union all ".join(rows) + ")"


@query(_found_sql())
def q_extract_facts(spark, sf_dir):
    """Symbols with their ends, imports, calls, bases, tables, sections and configurations of twelve kinds of files."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))

    def by_kind(column: int):
        out = F.lit(None).cast("string")
        for n, made in enumerate(MADE.values()):
            out = F.when(F.col("k") % len(MADE) == n, F.expr(made[column]) if column == 0 else F.lit(made[column])).otherwise(out)
        return out

    files = parts.select("k", by_kind(0).alias("path"), by_kind(1).alias("category"), by_kind(2).alias("language"), by_kind(3).alias("content")).withColumn("content_hash", F.sha2("content", 256))
    facts = extract.facts(files).where("fact <> 'route' and coalesce(type, '') <> 'file'")
    return facts.join(files.select("k", "path"), "path").select("k", "fact", "type", "name", "line_start", "line_end", "source", "target")


EVENTS = "select doc_id as seq, source || '/' || doc_id % 97 || '.md' as path, case when doc_id % 11 = 0 then 'D' else 'M' end as status, text as content, doc_id % 3 as batch from documents"


@query(f"""with e as ({EVENTS}), b as (select path, batch, max_by(status, seq) as status, max(seq) as seq from e group by 1, 2), f as (select path, max_by(status, batch) as status, max(batch) as batch, max_by(seq, batch) as seq from b group by 1)
select 'file' as kind, path as id, status, cast(batch as int) as batch from f
union all select 'node', 'document:' || left(sha256('document' || chr(31) || path), 24), status, cast(batch as int) from f where status = 'M'
union all select 'change', path || ':' || seq, status, cast(batch as int) from e""")
def q_update_log(spark, sf_dir):
    """Three batches of file events, the second run twice: the merged state."""
    docs = table(spark, sf_dir, "documents")
    events = docs.select(F.col("doc_id").alias("seq"), F.concat("source", F.lit("/"), (F.col("doc_id") % 97).cast("string"), F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 11 == 0, "D").otherwise("M").alias("status"), F.col("text").alias("content"), F.lit("document").alias("category"), F.lit("markdown").alias("language"), F.sha2("text", 256).alias("content_hash"))
    root = folder(spark, "log")
    run = updates.updater(root)
    for batch in (0, 1, 1, 2):
        run(events.where(F.col("seq") % 3 == batch), batch)
    state = lambda name: updates.current(spark, root, name)
    files = state("files").select(F.lit("file").alias("kind"), F.col("path").alias("id"), "status", F.col("batch").cast("int").alias("batch"))
    nodes = state("nodes").where("type = 'document'").join(state("files").select(F.col("path").alias("file_path"), "status"), "file_path").select(F.lit("node"), "id", "status", F.col("batch").cast("int"))
    changes = state("changes").select(F.lit("change"), F.concat("path", F.lit(":"), F.col("seq").cast("string")), "status", F.col("batch").cast("int"))
    return files.union(nodes).union(changes)


#: Made-up route files in both engines' words.
PY_ROUTES = ("'@app.get(\"/p/' || k || '\")'", "case when k % 2 = 0 then '@router.websocket(''/ws'')' else '# none' end", "'@bp.route(''/f/' || k || ''', methods=[''POST'', ''PUT''])'", "'urlpatterns = [path(''users/' || k || ''', views.users)]'")
NEST_ROUTES = ("'@Get(''early'')'", "'@Controller(''u' || k || ''')'", "'class U {'", "' @Get('':id'')'", "case when k % 2 = 0 then ' @Post()' else '' end", "'}'", "'@Controller()'", "' @All(''z'') c() {}'")


@query("""with p as (select p_partkey as k from part) select k, 'GET' as method, '/p/' || k as route, 1 as line from p union all select k, 'WEBSOCKET', '/ws', 2 from p where k % 2 = 0
union all select k, m, '/f/' || k, 3 from p, (values ('ANY'), ('POST'), ('PUT')) v(m) union all select k, 'ANY', 'users/' || k, 4 from p""")
def q_routes_python(spark, sf_dir):
    return routes.python_routes(_made(spark, sf_dir, PY_ROUTES, "'a/' || k || '.py'", "python").select("k", "content")).select("k", "method", "route", "line")


@query("""with p as (select p_partkey as k from part) select 'u/' || k || '.ts' as path, 'GET' as method, '/early' as route, 1 as line from p union all select 'u/' || k || '.ts', 'GET', '/u' || k || '/:id', 4 from p
union all select 'u/' || k || '.ts', 'POST', '/u' || k, 5 from p where k % 2 = 0 union all select 'u/' || k || '.ts', 'ANY', '/z', 8 from p""")
def q_routes_nest(spark, sf_dir):
    return routes.nest_routes(_made(spark, sf_dir, NEST_ROUTES, "'u/' || k || '.ts'", "typescript").select("path", "content"))


@query(f"""with p as (select p_partkey as k from part), f as (select k, string_split({joined(NESTED)}, chr(10)) as ls from p),
s as (select k, n, unnest([2, 8]) as a from (select k, 1 as n from p)), z as (select k, a, case when a = 2 then 3 + k % 3 else 10 end as b from s)
select 'chunk:' || left(sha256('src/' || f.k || '.ts' || chr(31) || a || chr(31) || b || chr(31) || sha256(array_to_string(ls[a:b], chr(10)))), 24) as id, cast(a as int) as line_start, cast(b as int) as line_end,
       sha256(array_to_string(ls[a:b], chr(10))) as content_hash, cast(greatest(1, length(array_to_string(ls[a:b], chr(10))) // 4) as int) as token_estimate from z join f on f.k = z.k where f.k % 4 <> 0
union all select 'chunk:' || left(sha256('src/' || k || '.ts' || chr(31) || '1' || chr(31) || len(ls) || chr(31) || sha256(array_to_string(ls, chr(10)))), 24), 1, cast(len(ls) as int), sha256(array_to_string(ls, chr(10))), cast(greatest(1, length(array_to_string(ls, chr(10))) // 4) as int) from f where k % 4 = 0""")
def q_chunk_symbols(spark, sf_dir):
    """Chunks by symbols, with ids, hashes and token estimates; files without symbols are one window."""
    files = _made(spark, sf_dir, NESTED, "'src/' || k || '.ts'", "typescript")
    spans_ = files.where("k % 4 <> 0").select(F.col("path").alias("file_path"), F.explode(F.array(F.struct(F.lit(2).alias("line_start"), (3 + F.col("k") % 3).cast("int").alias("line_end")), F.struct(F.lit(8).alias("line_start"), F.lit(10).alias("line_end")))).alias("s"))
    nodes = spans_.select("file_path", F.lit("function").alias("type"), "s.line_start", "s.line_end")
    found = chunking.materialized(chunking.symbols(files.select("path", "content"), nodes))
    return found.select("id", "line_start", "line_end", "content_hash", "token_estimate")


@query("select p_partkey as k, regexp_replace(p_name || '.x', '[^\\pL\\pN_-]', '_', 'g') as name, case when s = '' then 'section' else s end as slug from (select p_partkey, p_name, trim(regexp_replace(lower(case when p_partkey % 50 = 0 then '--' else p_name || '  (' || p_brand || ')!' end), '[^a-z0-9]+', '-', 'g'), '-') as s from part)")
def q_slugs(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 50 == 0, "--").otherwise(F.concat("p_name", F.lit("  ("), "p_brand", F.lit(")!")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), safe_filename(F.concat("p_name", F.lit(".x"))).alias("name"), slug(title).alias("slug"))


@query(f"with {NODES_SQL}, n as (select * from nodes order by qualified_name, id limit 500), m as (select left(regexp_replace(qualified_name, '[^\\pL\\pN_-]', '_', 'g'), 120) || '.md' as name, id, '# ' || name || chr(10) || chr(10) || '- type: ' || type || chr(10) || '- file: ' || coalesce(file_path, '') || chr(10) as content from n) select name, max_by(content, id) as content from m group by name")
def q_note_files(spark, sf_dir):
    """Note files of the first nodes."""
    return exports.notes(tb.nodes(spark, sf_dir))


@query(f"with {NODES_SQL}, e as (select id, 0 as s from nodes where name = 'supplier' or qualified_name = 'supplier' or coalesce(file_path, '') = 'supplier' union all select id, 1 from nodes where contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(qualified_name || ' ' || name), '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ', ' supplier ')), r as (select id, min(s) as s from e group by id order by s, id limit 10) select r.id, '- ' || type || ' `' || qualified_name || '`' as bullet from r join nodes using (id)")
def q_bullets(spark, sf_dir):
    """What a refactoring starts from: the nodes that match best."""
    return lookups.bullets(tb.nodes(spark, sf_dir), "supplier")
