import fnmatch
import hashlib

import pytest
from pyspark.sql import functions as F

from codeloom.functions import ids, matching, paths, text
from codeloom.operators import chunking, diffs, risk, search


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


def test_ids(spark):
    want = hashlib.sha256("function\x1fsrc/auth.py::login".encode()).hexdigest()[:24]
    assert one(spark, ids.node_id(F.col("a"), F.col("b")), a="function", b="src/auth.py::login") == f"function:{want}"
    assert one(spark, ids.normalize_path(F.col("a")), a="./.env") == ".env" and one(spark, ids.normalize_path(F.col("a"), compatible=True), a="./.env") == "env"


def test_paths_and_globs(spark):
    cases = {"src/a.py": ("code", "python"), "README.md": ("document", "markdown"), ".env": ("config", "env"), "x/.github/w.yml": ("infra", "github-actions"), "K8S/a.yaml": ("infra", "kubernetes"), "a.yaml": ("config", "yaml"), "x.Dockerfile": ("infra", "dockerfile"), "v.tfvars": ("infra", "terraform"), "x.bin": ("unknown", None), "makefile": ("unknown", None)}
    for path, want in cases.items():
        assert tuple(one(spark, paths.classify(F.col("a")), a=path)) == want, path
    frame = spark.createDataFrame([(p,) for p in ("node_modules/a.js", "a/node_modules/b", "x.pyc", "a/b.lock", "src/a.py", "a/b/c.txt", "build")], "p string").collect()
    for pattern in ("*.py", "a/**", "[!s]*", "?.pyc", "build", "a/*/c.txt", "[a-c]/*"):
        for r in frame:
            got = one(spark, F.col("a").rlike(paths.glob_regex(pattern)), a=r.p)
            assert got == fnmatch.fnmatchcase(r.p, pattern), (pattern, r.p)
    assert one(spark, paths.ignored(F.col("a")), a="node_modules/a.js") and not one(spark, paths.ignored(F.col("a")), a="a/node_modules/b")


def test_redaction_and_lines(spark):
    got = one(spark, text.redact(F.col("a")), a="x = 1\napi_key = 5\npassword: y\nmy token here\n")
    assert got == "x = 1\napi_key=<redacted>\npassword: <redacted>\n<redacted secret-like line>"
    for t in ("", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\x0bd e"):
        assert one(spark, text.lines(F.col("a")), a=t) == t.splitlines(), repr(t)
    assert one(spark, text.slug(F.col("a")), a=" Héllo, World! ") == "h-llo-world" and one(spark, text.slug(F.col("a")), a="!!") == "section"


def test_match_lines(spark):
    got = one(spark, matching.matches(F.col("a"), r"(?m)^\s*def (\w+)", 1), a="x\n\n\ndef a\n  def b\ndef c")
    assert [(m.line, m.g1) for m in got] == [(4, "a"), (5, "b"), (6, "c")]


def test_chunks(spark):
    files = spark.createDataFrame([("m", "skip\n\n# One\na\n## Two\nb\n"), ("s", "SELECT 1;\nSELECT\n2;\nrest")], "path string, content string")
    got = [(r.line_start, r.line_end) for r in chunking.sections(files.where("path = 'm'")).collect()]
    assert got == [(3, 4), (5, 6)]
    assert [(r.line_start, r.line_end) for r in chunking.statements(files.where("path = 's'")).collect()] == [(1, 1), (2, 3), (4, 4)]


def test_diff_of_two_files(spark):
    patch = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,3 @@\n ctx\n-old\n+new\n+more\ndiff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -5 +7 @@\n-x\n+y\n"
    lines = diffs.numbered(diffs.patch_lines(spark.createDataFrame([(1, patch)], "patch_id long, patch string")))
    got = [(r.file_path, r.new_start, r.new_count, r.changed_lines) for r in diffs.hunks(lines).orderBy("file_path").collect()]
    assert got == [("a.py", 1, 3, [2, 2, 3]), ("b.py", 7, 1, [7, 7])]
    nodes = spark.createDataFrame([("f1", "function", "a.py", 1, 1), ("f2", "function", "a.py", 2, 4), ("file", "file", "a.py", 1, 9)], "id string, type string, file_path string, line_start int, line_end int")
    changed = spark.createDataFrame([("a.py", 2)], "file_path string, line int")
    assert [r.id for r in diffs.touched_nodes(changed, nodes).collect()] == ["f2"]


def test_migrations(spark):
    rows = [("migrations/1.sql", "+ALTER TABLE a ADD COLUMN b INT NOT NULL;\n+ALTER TABLE a ADD COLUMN c INT NOT NULL DEFAULT 1;\n-DROP TABLE gone;\n+  op.drop_column('a', 'b')"), ("src/a.py", "+DROP TABLE a;")]
    got = {(r.code, r.severity, r.snippet) for r in risk.migration_warnings(spark.createDataFrame(rows, "path string, patch string")).collect()}
    assert got == {("add_not_null_no_default", "high", "ALTER TABLE a ADD COLUMN b INT NOT NULL;"), ("alembic_drop_column", "high", "op.drop_column('a', 'b')")}


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0)])
def test_cosine(spark, a, b, want):
    frame = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert frame.select(search.cosine(F.col("a"), F.col("b")).alias("x")).first().x == want
