"""Classification, test and generated-file rules, and glob patterns over path columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file ending.
CODE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
    ".java": "java", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby",
    ".php": "php", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".scala": "scala", ".dart": "dart", ".lua": "lua", ".sh": "bash",
    ".bash": "bash", ".sql": "sql", ".vue": "vue", ".svelte": "svelte",
}
DOCUMENT = {".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".txt": "text", ".pdf": "pdf", ".docx": "office"}
CONFIG = {".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".env": "env"}
#: What is never scanned.
DEFAULT_EXCLUDES = (".git/**", "node_modules/**", "dist/**", "build/**", ".venv/**", "__pycache__/**", "*.pyc", "*.lock")
KUBERNETES_DIRS = ("k8s", "kubernetes", "manifests")
TEST_ENDINGS = ("_test.py", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx")
GENERATED_ENDINGS = (".min.js", ".bundle.js", ".map")
GENERATED_MARKS = ("generated by", "@generated", "do not edit")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last ending of the file name with its dot, or an empty text; a leading dot starts no ending."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def _ends(text: Column, endings: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for e in endings:
        found = found | F.endswith(text, F.lit(e))
    return found


def classify(path: Column) -> Column:
    """(category, language) of a path, first rule first."""
    base, ending, parts = name(path), F.lower(suffix(path)), F.split(path, "/")
    pair = lambda category, language: F.struct(F.lit(category).alias("category"), F.lit(language).cast("string").alias("language"))
    yaml = ending.isin(".yml", ".yaml")
    out = F.when((base == "Dockerfile") | F.endswith(base, F.lit(".Dockerfile")), pair("infra", "dockerfile"))
    out = out.when(ending.isin(".tf", ".tfvars"), pair("infra", "terraform"))
    out = out.when(yaml & F.array_contains(parts, ".github"), pair("infra", "github-actions"))
    out = out.when(yaml & F.exists(parts, lambda p: F.lower(p).isin(*KUBERNETES_DIRS)), pair("infra", "kubernetes"))
    for category, endings in (("code", CODE), ("document", DOCUMENT)):
        known = F.create_map(*[F.lit(x) for kv in endings.items() for x in kv])
        out = out.when(ending.isin(*endings), F.struct(F.lit(category).alias("category"), F.try_element_at(known, ending).alias("language")))
    out = out.when(F.endswith(base, F.lit(".env")), pair("config", "env"))
    known = F.create_map(*[F.lit(x) for kv in CONFIG.items() for x in kv])
    out = out.when(ending.isin(*CONFIG), F.struct(F.lit("config").alias("category"), F.try_element_at(known, ending).alias("language")))
    return out.otherwise(pair("unknown", None))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    parts = F.split(low, "/")
    return F.array_contains(parts, "test") | F.array_contains(parts, "tests") | F.startswith(name(low), F.lit("test_")) | _ends(name(low), TEST_ENDINGS)


def is_generated(path: Column, content: Column) -> Column:
    head = F.lower(F.left(content, F.lit(500)))
    marked = F.lit(False)
    for mark in GENERATED_MARKS:
        marked = marked | F.contains(head, F.lit(mark))
    return _ends(F.lower(name(path)), GENERATED_ENDINGS) | marked


def is_test_symbol(symbol: Column) -> Column:
    low = F.lower(symbol)
    return F.startswith(low, F.lit("test")) | F.endswith(low, F.lit("test")) | F.contains(low, F.lit(".test")) | F.contains(low, F.lit(".spec"))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for whole texts; ``*`` crosses slashes."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = pattern[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]")
            k = end
        elif c.isalnum() or c in "_/ ":
            out.append(c)
        else:
            out.append("\\" + c)
        k += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def _fits(regex: str):
    return lambda part: part.rlike(regex)


def ignored(path: Column, patterns: tuple[str, ...] = DEFAULT_EXCLUDES) -> Column:
    """Whether a pattern fits the path, its file name or, for patterns without a slash, one of its parts."""
    found = F.lit(False)
    for pattern in patterns:
        p = pattern.strip()
        if not p or p.startswith("#"):
            continue
        p += "**" if p.endswith("/") else ""
        regex = glob_regex(p)
        found = found | path.rlike(regex) | name(path).rlike(regex)
        if "/" not in p:
            found = found | F.exists(F.split(path, "/"), _fits(regex))
    return found


def included(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the include list lets a path in; an empty list lets all in."""
    if not patterns or {"*", "**", "**/*"} & set(patterns):
        return F.lit(True)
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(glob_regex(p))
        if p.endswith("/**"):
            found = found | (path == p[:-3]) | F.startswith(path, F.lit(p[:-2]))
    return found
