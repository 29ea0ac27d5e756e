"""Facts out of files: nodes and edges by language.

``files`` has path, category, language, content, content_hash. Regular languages are read by
pattern tables inside the file's own row, one projection for all languages, so nothing is
scanned twice or shuffled; only Python's grammar and YAML/TOML need Python, in Arrow batches.
A fact is a row (fact, path, type, name, qualified_name, line_start, line_end, source, target,
tags, metadata); ``nodes`` and ``edges`` turn facts into the graph's tables.
"""

from __future__ import annotations

import ast
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions.ids import edge_id, node_id
from codeloom.functions.matching import matches
from codeloom.functions.text import redact, slug
from codeloom.operators import lookups, routes, spans

#: language(s), kind, pattern in Java's dialect.
SYMBOLS = (
    ("javascript typescript", "class", r"\bclass\s+([A-Za-z_$][\w$]*)"),
    ("javascript typescript", "function", r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\("),
    ("javascript typescript", "function", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\("),
    ("go", "function", r"(?m)^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\("),
    ("go", "type", r"(?m)^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b"),
    ("rust", "function", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*[<(]"),
    ("rust", "type", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)"),
    ("java", "class", r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"),
    ("java", "function", r"(?m)^\s*(?:public|private|protected|static|final|synchronized|abstract|native|\s)+[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\("),
    ("c cpp", "class", r"\b(?:class|struct|enum)\s+([A-Za-z_]\w*)"),
    ("c cpp", "function", r"(?m)^\s*(?:static\s+|inline\s+|extern\s+|virtual\s+|constexpr\s+)*[A-Za-z_][\w:<>,~*&\s]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{"),
    ("csharp", "class", r"\b(?:class|interface|struct|enum|record)\s+([A-Za-z_]\w*)"),
    ("csharp", "function", r"(?m)^\s*(?:public|private|protected|internal|static|async|virtual|override|sealed|partial|\s)+[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\("),
    ("ruby", "class", r"(?m)^\s*class\s+([A-Za-z_:]\w*)"),
    ("ruby", "type", r"(?m)^\s*module\s+([A-Za-z_:]\w*)"),
    ("ruby", "function", r"(?m)^\s*def\s+(?:self\.)?([A-Za-z_]\w*[!?=]?)"),
    ("php", "class", r"\b(?:class|interface|trait|enum)\s+([A-Za-z_]\w*)"),
    ("php", "function", r"\bfunction\s+([A-Za-z_]\w*)\s*\("),
    ("kotlin", "class", r"\b(?:class|interface|object|data\s+class|enum\s+class)\s+([A-Za-z_]\w*)"),
    ("kotlin", "function", r"(?m)^\s*(?:public|private|protected|internal|suspend|inline|\s)*fun\s+([A-Za-z_]\w*)\s*[<(]"),
    ("swift", "class", r"\b(?:class|struct|enum|protocol|actor)\s+([A-Za-z_]\w*)"),
    ("swift", "function", r"(?m)^\s*(?:public|private|internal|fileprivate|open|static|class|\s)*func\s+([A-Za-z_]\w*)\s*\("),
    ("scala", "class", r"\b(?:class|object|trait|enum)\s+([A-Za-z_]\w*)"),
    ("scala", "function", r"(?m)^\s*(?:private|protected|override|implicit|inline|\s)*def\s+([A-Za-z_]\w*)\s*[(:=]"),
    ("dart", "class", r"\b(?:class|mixin|enum|extension)\s+([A-Za-z_]\w*)"),
    ("dart", "function", r"(?m)^\s*(?:static\s+|async\s+)?(?:[A-Za-z_][\w<>?]*\s+)?([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:async\s*)?\{"),
    ("lua", "function", r"(?m)^\s*(?:local\s+)?function\s+([A-Za-z_][\w.:]*)\s*\("),
    ("lua", "function", r"(?m)^\s*([A-Za-z_]\w*)\s*=\s*function\s*\("),
    ("bash", "function", r"(?m)^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*(?:\(\))\s*\{"),
    ("bash", "function", r"(?m)^\s*function\s+([A-Za-z_][\w-]*)\s*\{"),
)
#: language(s), pattern of an import with the name in its first group.
IMPORTS = (
    ("javascript typescript vue svelte", r"(?m)^\s*import\s+(?:.+?\s+from\s+)?[\"']([^\"']+)[\"']"),
    ("javascript typescript vue svelte", r"(?m)^\s*const\s+\w+\s*=\s*require\([\"']([^\"']+)[\"']\)"),
    ("rust", r"(?m)^\s*use\s+([^;]+);"),
    ("java", r"(?m)^\s*import\s+(?:static\s+)?([^;]+);"),
    ("c cpp", r"(?m)^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]"),
    ("csharp", r"(?m)^\s*using\s+([^;]+);"),
    ("ruby lua", r"(?m)^\s*(?:require|require_relative)\s+['\"]([^'\"]+)['\"]"),
    ("php", r"(?m)^\s*(?:use|include|require(?:_once)?)\s+['\"]?([^;'\"]+)['\"]?\s*;"),
    ("kotlin swift scala dart", r"(?m)^\s*import\s+([^;\n]+)"),
    ("bash", r"(?m)^\s*(?:source|\.)\s+(.+)$"),
)
#: Calls and words that are none, tables in SQL, blocks of Terraform.
CALL = r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\s*\("
NO_CALLS = ("if", "for", "while", "switch", "catch", "function", "return")
TABLES = r"(?i)\b(FROM|JOIN|UPDATE|INTO|TABLE(?:\s+IF\s+NOT\s+EXISTS)?)\s+[`\"\[]?([A-Za-z_][\w.$-]*)"
TERRAFORM = r'(?m)^\s*(resource|data|module|variable|output)\s+"([^"]+)"(?:\s+"([^"]+)")?'
#: Headings by number signs or a line under them, and keys of environment files.
HEADING = r"(?m)^(#{1,6})\s+(.+)$"
UNDERLINED = r"(?m)^(.+)\n([=\-~`^#*]{3,})$"
ENV_KEY = r"(?m)^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*="

FACT = "fact string, path string, type string, name string, qualified_name string, line_start int, line_end int, source string, target string, tags array<string>, metadata string"
_LINE = "array<struct<kind:string,name:string,line:int>>"


def _by_language(table: tuple, read) -> Column:
    """Matches of every pattern of the row's language, flattened."""
    none = F.array().cast(_LINE)
    return F.flatten(F.array(*[F.when(F.col("language").isin(*row[0].split()), read(*row[1:])).otherwise(none) for row in table]))


def _named(kind: str, pattern: str) -> Column:
    return F.transform(matches(F.col("content"), pattern, 1), lambda m: F.struct(F.lit(kind).alias("kind"), F.trim(m["g1"]).alias("name"), m["line"].alias("line")))


def module_name() -> Column:
    """Dotted path; Python's without its ending."""
    return F.regexp_replace(F.translate("path", "/", "."), r"\.py$", "")


def go_imports(lines: Column) -> Column:
    """Imports of Go: quoted names on ``import`` lines and inside blocks, by one fold over the lines that knows whether it is in a block."""
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("at"), F.array().cast(_LINE).alias("found"))

    def step(acc: Column, line: Column) -> Column:
        x, at = F.trim(line, F.lit(" \t\r\x0b\x0c")), acc["at"] + 1
        opens, closes = F.startswith(x, F.lit("import (")), acc["inside"] & (x == ")")
        reads = ~opens & ~closes & (acc["inside"] | F.startswith(x, F.lit("import ")))
        names = F.transform(F.regexp_extract_all(x, F.lit('"([^"]+)"'), F.lit(1)), lambda n: F.struct(F.lit("import").alias("kind"), n.alias("name"), at.alias("line")))
        return F.struct((opens | (acc["inside"] & ~closes)).alias("inside"), at.alias("at"), F.when(reads, F.concat(acc["found"], names)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(lines, zero, step, lambda acc: acc["found"])


def _facts(rows: DataFrame, fact: str, **columns: Column) -> DataFrame:
    kinds = dict(c.split(" ", 1) for c in FACT.split(", "))
    given = {"fact": F.lit(fact), "path": F.col("path")} | columns
    return rows.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]))


def file_facts(files: DataFrame) -> DataFrame:
    size = F.greatest(F.lit(1), F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1)
    return _facts(
        files, "node", type=F.lit("file"), name=paths.name(F.col("path")), qualified_name=F.col("path"), line_start=F.lit(1), line_end=size, tags=F.array("category"),
        metadata=_json(category=F.col("category"), is_generated=paths.is_generated(F.col("path"), F.col("content")), is_test=paths.is_test(F.col("path"))),
    )


def code_facts(files: DataFrame) -> DataFrame:
    """Modules, symbols, imports, and calls of one symbol to another of the same file, by patterns."""
    code = files.where("category = 'code' and language not in ('python', 'sql')")
    lines = F.split("content", "\n", -1)
    read = code.select(
        "path", "language", lines.alias("ls"), module_name().alias("module"),
        F.array_distinct(_by_language(SYMBOLS, _named)).alias("symbols"),
        F.concat(_by_language(IMPORTS, lambda p: _named("import", p)), F.when(F.col("language") == "go", go_imports(lines)).otherwise(F.array().cast(_LINE))).alias("imports"),
        F.when(~F.col("language").isin("vue", "svelte"), F.filter(_named("call", CALL), lambda c: ~c["name"].isin(*NO_CALLS))).otherwise(F.array().cast(_LINE)).alias("calls"),
    )
    modules = _facts(read, "node", type=F.lit("module"), name=paths.stem(F.col("path")), qualified_name=F.col("module"), line_start=F.lit(1), line_end=F.greatest(F.lit(1), F.size("ls")), metadata=_json(parser=F.lit("patterns")))
    component = _facts(read.where("language in ('vue', 'svelte')"), "node", type=F.lit("class"), name=paths.stem(F.col("path")), qualified_name=F.concat("module", F.lit("::"), paths.stem(F.col("path"))), line_start=F.lit(1), line_end=F.size("ls"))
    each = read.select("path", "module", F.explode(F.arrays_zip(F.col("symbols").alias("s"), spans.spans(F.col("ls"), F.col("symbols")).alias("at"))).alias("z")).select("path", "module", "z.s", "z.at")
    test = paths.is_test_symbol(F.col("s.name")) & (F.col("s.kind") == "function")
    kind = F.when(test, "test").otherwise(F.col("s.kind"))
    symbols = _facts(each, "node", type=kind, name=F.col("s.name"), qualified_name=F.concat("module", F.lit("::"), "s.name"), line_start=F.col("s.line"), line_end=F.col("at.end"), metadata=_json(parser=F.lit("patterns")))
    imports = _facts(read.select("path", "module", F.explode("imports").alias("s")), "import", source=F.col("module"), target=F.col("s.name"), line_start=F.col("s.line"))
    calls = read.select("path", "module", "symbols", F.explode("calls").alias("c"))
    before = lambda: F.filter("symbols", lambda s: s["line"] <= F.col("c.line"))
    ordered = lambda s: F.struct(s["line"].alias("line"), s["name"].alias("name"), s["kind"].alias("kind"))
    at_top = F.struct(F.lit(0).alias("line"), F.lit("").alias("name"), F.lit("module").alias("kind"))
    caller = F.coalesce(F.try_element_at(F.array_sort(F.transform(before(), ordered)), F.lit(-1)), at_top)
    named = F.filter("symbols", lambda s: s["name"] == F.element_at(F.split("c.name", r"\."), -1))
    callee = F.element_at(F.array_sort(F.transform(named, ordered)), -1)
    pairs = calls.where(F.size(named) > 0).select("path", "module", "c", caller.alias("a"), callee.alias("b")).where("a.name <> b.name")
    qualified = lambda s: F.when(F.col(f"{s}.kind") == "module", F.col("module")).otherwise(F.concat("module", F.lit("::"), F.col(f"{s}.name")))
    typed = lambda s: F.when(paths.is_test_symbol(F.col(f"{s}.name")) & (F.col(f"{s}.kind") == "function"), "test").otherwise(F.col(f"{s}.kind"))
    used = _facts(pairs, "call", type=typed("a"), tags=F.array(typed("b")), source=qualified("a"), target=qualified("b"), line_start=F.col("c.line"), metadata=_json(call=F.col("c.name")))
    return modules.unionByName(component).unionByName(symbols).unionByName(imports).unionByName(used)


def sql_facts(files: DataFrame) -> DataFrame:
    """Tables that statements read from or write to; a table is one node for all files."""
    found = files.where("language = 'sql'").select("path", F.explode(F.array_distinct(matches(F.col("content"), TABLES, 2))).alias("m"))
    action = F.when(F.upper("m.g1").rlike("^(FROM|JOIN)$"), "reads_from").otherwise("writes_to")
    return _facts(found.distinct(), "table", type=action, name=F.col("m.g2"), target=F.concat(F.lit("database::"), "m.g2"), line_start=F.col("m.line"))


def section_facts(files: DataFrame) -> DataFrame:
    """Documents with their sections; equal headings of one file get a number."""
    docs = files.where("category = 'document'")
    head = F.transform(matches(F.col("content"), HEADING, 2), lambda m: F.struct(m["line"].alias("line"), F.length(m["g1"]).alias("level"), F.trim(m["g2"]).alias("title")))
    under = F.transform(matches(F.col("content"), UNDERLINED, 2), lambda m: F.struct(m["line"].alias("line"), F.lit(1).alias("level"), F.trim(m["g1"]).alias("title")))
    found = F.when(F.col("language") == "markdown", head).when(F.col("language") == "rst", under)
    document = _facts(docs, "node", type=F.lit("document"), name=paths.name(F.col("path")), qualified_name=F.col("path"), line_start=F.lit(1))
    rows = docs.select("path", found.alias("hs")).where("hs is not null").withColumn("slugs", F.transform("hs", lambda h: slug(h["title"])))
    each = rows.select("path", "slugs", F.posexplode("hs").alias("k", "h"))
    nth = F.size(F.filter(F.slice("slugs", F.lit(1), F.col("k") + 1), lambda s: s == F.element_at("slugs", F.col("k") + 1)))
    sections = _facts(each, "section", type=F.lit("section"), name=F.col("h.title"), qualified_name=F.concat("path", F.lit("#"), F.element_at("slugs", F.col("k") + 1), F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise("")), line_start=F.col("h.line"), line_end=F.col("h.line"), metadata=_json(level=F.col("h.level")))
    return document.unionByName(sections)


def config_facts(files: DataFrame) -> DataFrame:
    """Configs with their top-level keys: JSON and .env by functions, YAML and TOML parsed in batches. Values are never kept."""
    rows = files.where("category in ('config', 'infra')")
    keys = F.when(F.col("language") == "json", F.json_object_keys("content")).when(F.col("language") == "env", F.array_distinct(F.regexp_extract_all("content", F.lit(ENV_KEY), F.lit(1))))
    simple = rows.where("language in ('json', 'env')").select("path", "language", keys.alias("keys"), F.lit(None).cast("array<string>").alias("resources"))
    parsed = rows.where("language in ('yaml', 'toml', 'kubernetes', 'github-actions')").select("path", "language", "content").mapInPandas(_parsed_configs, "path string, language string, keys array<string>, resources array<string>")
    known = simple.unionByName(parsed)
    kind = F.when(F.col("language") == "kubernetes", "resource").when(F.col("language") == "github-actions", "pipeline").otherwise("config")
    whole = _facts(known, "node", type=kind, name=paths.name(F.col("path")), qualified_name=F.col("path"), line_start=F.lit(1), tags=F.when(F.col("keys").isNull(), F.array(F.lit("parse_error"))).otherwise(F.array().cast("array<string>")), metadata=_json(keys=F.col("keys"), resources=F.col("resources")))
    docker = _facts(rows.where("language = 'dockerfile'"), "node", type=F.lit("resource"), name=paths.name(F.col("path")), qualified_name=F.col("path"), line_start=F.lit(1))
    terraform = rows.where("language = 'terraform'")
    root = _facts(terraform, "node", type=F.lit("resource"), name=paths.name(F.col("path")), qualified_name=F.col("path"), line_start=F.lit(1))
    found = terraform.select("path", F.explode(matches(F.col("content"), TERRAFORM, 3)).alias("m"))
    name = F.concat("m.g1", F.lit("."), F.col("m.g2"), F.when(F.col("m.g3") != "", F.concat(F.lit("."), "m.g3")).otherwise(""))
    inner = _facts(found, "section", type=F.lit("resource"), name=name, qualified_name=F.concat("path", F.lit("::"), name), line_start=F.col("m.line"), line_end=F.col("m.line"), metadata=_json(kind=F.col("m.g1")))
    return whole.unionByName(docker).unionByName(root).unionByName(inner)


def _parsed_configs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    def read(language: str, text: str) -> tuple[list[str] | None, list[str] | None]:
        try:
            documents = [tomllib.loads(text)] if language == "toml" else [d for d in yaml.safe_load_all(text) if d is not None]
        except (yaml.YAMLError, tomllib.TOMLDecodeError):
            return None, None
        keys = [str(k) for d in documents[:1] if isinstance(d, dict) for k in d]
        kinds = [f"{d.get('apiVersion', '')}/{d.get('kind', '')}/{(d.get('metadata') or {}).get('name', '')}" for d in documents if isinstance(d, dict)] if language == "kubernetes" else None
        return keys, kinds

    for b in batches:
        found = [read(*x) for x in zip(b.language, b.content, strict=True)]
        yield pd.DataFrame({"path": b.path, "language": b.language, "keys": [k for k, _ in found], "resources": [r for _, r in found]})


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return _dotted(node.func) if isinstance(node, ast.Call) else _dotted(node.value) if isinstance(node, ast.Subscript) else ""


class _Symbols(ast.NodeVisitor):
    """Classes, functions, imports and calls of one module, as rows of FACT."""

    def __init__(self, path: str, module: str):
        self.path, self.module, self.rows = path, module, []
        self.owners: list[str] = []
        self.inside: list[tuple[str, str]] = []
        self.named: dict[str, tuple[str, str]] = {}
        self.calls: list[tuple[tuple[str, str], str, int]] = []

    def add(self, fact: str, **fields) -> None:
        self.rows.append({"fact": fact, "path": self.path} | fields)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        name = f"{self.module}.{node.name}"
        self.named[node.name] = ("class", name)
        self.add("node", type="class", name=node.name, qualified_name=name, line_start=node.lineno, line_end=node.end_lineno)
        for base in filter(None, map(_dotted, node.bases)):
            self.add("inherit", type="class", source=name, target=base, line_start=node.lineno)
        self.owners.append(node.name)
        self.generic_visit(node)
        self.owners.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        name = ".".join([self.module, *self.owners[:1], node.name])
        low = node.name.lower()
        kind = "test" if low.startswith("test") or low.endswith("test") or ".test" in low or ".spec" in low else "function"
        branches = sum(isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)) for x in ast.walk(node)) + sum(len(x.values) - 1 for x in ast.walk(node) if isinstance(x, ast.BoolOp))
        self.named[node.name] = (kind, name)
        self.add("node", type=kind, name=node.name, qualified_name=name, line_start=node.lineno, line_end=node.end_lineno, tags=["async"] if isinstance(node, ast.AsyncFunctionDef) else [], metadata=json.dumps({"complexity": branches + 1}))
        self.inside.append((kind, name))
        self.generic_visit(node)
        self.inside.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self.add("import", source=self.module, target=alias.name, line_start=node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module:
            self.add("import", source=self.module, target=node.module, line_start=node.lineno)

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        if name and self.inside:
            self.calls.append((self.inside[-1], name, node.lineno))
        self.generic_visit(node)

    def finish(self) -> list[dict]:
        for caller, name, line in self.calls:
            callee = self.named.get(name.split(".")[-1])
            if callee and callee != caller:
                self.add("call", type=caller[0], tags=[callee[0]], source=caller[1], target=callee[1], line_start=line, metadata=json.dumps({"call": name}))
        return self.rows


def _python_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in FACT.split(", ")]
    for b in batches:
        rows: list[dict] = []
        for path, text in zip(b.path, b.content, strict=True):
            module = path.replace("/", ".").removesuffix(".py")
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError) as e:
                rows.append({"fact": "warning", "path": path, "name": f"Python parse failed: {e}"})
                continue
            rows.append({"fact": "node", "path": path, "type": "module", "name": path.rsplit("/", 1)[-1].removesuffix(".py"), "qualified_name": module, "line_start": 1, "line_end": text.count("\n") + 1})
            walk = _Symbols(path, module)
            walk.visit(tree)
            rows += walk.finish()
        frame = pd.DataFrame(rows, columns=names)
        for c in ("line_start", "line_end"):
            frame[c] = frame[c].astype("Int32")
        yield frame.astype(object).where(frame.notna(), None)


def python_facts(files: DataFrame) -> DataFrame:
    return files.where("language = 'python'").select("path", "content").mapInPandas(_python_files, FACT)


def route_facts(files: DataFrame) -> DataFrame:
    """HTTP routes as endpoints of their modules."""
    python = files.where("language = 'python'").select("path", "content")
    script = files.where("category = 'code' and language in ('javascript', 'typescript')").select("path", "content")
    framework = lookups.python_framework(F.col("method"))
    own = F.regexp_replace(F.replace("path", F.lit("/"), F.lit(".")), r"\.py$", "")
    found = routes.python_routes(python).select("path", "method", "route", "line", framework.alias("framework"), own.alias("module"), F.lit("").alias("infix"))
    for name, read in (("express", routes.express_routes), ("nestjs", routes.nest_routes), ("nextjs", routes.next_routes)):
        found = found.union(read(script).select("path", "method", "route", "line", F.lit(name), module_name(), F.lit(f"{name}::")))
    title = F.concat_ws(" ", "method", "route")
    return _facts(found, "route", type=F.lit("api_endpoint"), name=title, qualified_name=F.concat("module", F.lit("::"), "infix", title), source=F.col("module"), line_start=F.col("line"), line_end=F.col("line"), metadata=_json(framework=F.col("framework"), method=F.col("method"), path=F.col("route")))


def facts(files: DataFrame) -> DataFrame:
    """All facts of all files; documents and configs are redacted before their facts are read."""
    safe = files.withColumn("content", F.when(F.col("category") == "document", redact(F.col("content"))).otherwise(F.col("content")))
    out = file_facts(safe)
    for read in (code_facts, python_facts, route_facts, sql_facts, section_facts, config_facts):
        out = out.unionByName(read(safe))
    return out


def nodes(found: DataFrame) -> DataFrame:
    """id, type, name, qualified_name, file_path, lines, tier, tags, metadata; the last fact of an id wins by line."""
    own = found.where("fact in ('node', 'section', 'route')").select("type", "name", "qualified_name", F.col("path").alias("file_path"), "line_start", "line_end", "tags", "metadata", F.lit("extracted").alias("confidence_tier"), F.lit(1.0).alias("confidence"))
    outer = found.where("fact in ('import', 'inherit')").select(F.lit("module").alias("type"), F.col("target").alias("name"), F.concat(F.lit("external::"), "target").alias("qualified_name"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(None).cast("array<string>").alias("tags"), F.lit('{"external":true}').alias("metadata"), F.lit("inferred").alias("confidence_tier"), F.lit(0.8).alias("confidence")).distinct()
    tables = found.where("fact = 'table'").select(F.lit("database_table").alias("type"), "name", F.col("target").alias("qualified_name"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("metadata"), F.lit("extracted").alias("confidence_tier"), F.lit(1.0).alias("confidence")).distinct()
    every = own.unionByName(outer).unionByName(tables).withColumn("id", node_id(F.col("type"), F.col("qualified_name")))
    rest = [c for c in every.columns if c != "id"]
    return every.groupBy("id").agg(F.max(F.struct("line_start", *[c for c in rest if c != "line_start"])).alias("r")).select("id", "r.*").select("id", *rest)


def edges(found: DataFrame) -> DataFrame:
    """contains, imports, inherits, calls, routes_to, reads_from and writes_to edges of the facts."""
    file = lambda: node_id(F.lit("file"), F.col("path"))
    external = lambda: node_id(F.lit("module"), F.concat(F.lit("external::"), F.col("target")))
    unread = found.where("fact = 'warning'").select("path").distinct().withColumn("unread", F.lit(True))  # files without a module
    routed = found.where("fact = 'route'").join(unread, "path", "left").withColumn("unread", F.coalesce("unread", F.lit(False)))
    made = [
        found.where("fact = 'node' and type <> 'file'").select(file().alias("s"), node_id(F.col("type"), F.col("qualified_name")).alias("t"), F.lit("contains").alias("k"), F.lit("extractor").alias("p"), "path", "line_start"),
        found.where("fact = 'section'").select(node_id(F.when(F.col("type") == "section", "document").otherwise("resource"), F.col("path")), node_id(F.col("type"), F.col("qualified_name")), F.lit("contains"), F.lit("sections"), "path", "line_start"),
        found.where("fact = 'import'").select(node_id(F.lit("module"), F.col("source")), external(), F.lit("imports"), F.concat(F.lit("imports:"), "target"), "path", "line_start"),
        found.where("fact = 'inherit'").select(node_id(F.lit("class"), F.col("source")), external(), F.lit("inherits"), F.lit("inherits"), "path", "line_start"),
        found.where("fact = 'call'").select(node_id(F.col("type"), F.col("source")), node_id(F.element_at("tags", 1), F.col("target")), F.lit("calls"), F.concat(F.lit("calls:"), F.col("line_start").cast("string")), "path", "line_start"),
        routed.select(F.when(F.col("unread"), file()).otherwise(node_id(F.lit("module"), F.col("source"))), node_id(F.col("type"), F.col("qualified_name")), F.lit("routes_to"), F.concat(F.lit("routes:"), "qualified_name"), "path", "line_start"),
        found.where("fact = 'table'").select(file(), node_id(F.lit("database_table"), F.col("target")), F.col("type"), F.concat(F.lit("sql:"), F.col("line_start").cast("string")), "path", "line_start"),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out.select(edge_id(F.col("s"), F.col("t"), F.col("k"), F.col("p")).alias("id"), F.col("s").alias("source_id"), F.col("t").alias("target_id"), F.col("k").alias("type"), F.col("p").alias("provenance_source"), F.col("path").alias("file_path"), F.col("line_start").alias("line"), F.lit("extracted").alias("confidence_tier")).dropDuplicates(["id"])


def env_preview(files: DataFrame) -> DataFrame:
    """.env files with their keys in order and every value hidden."""
    keys = F.regexp_extract_all("content", F.lit(ENV_KEY), F.lit(1))
    return files.where("language = 'env'").select("path", F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("=<redacted>"))), "\n").alias("content"))
