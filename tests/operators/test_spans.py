import random
import time

from pyspark.sql import functions as F

from codeloom.operators import chunking, embeddings, extensions, extract, spans


def walk(lines, start):
    """The definition: line by line from the symbol's start."""
    first = lines[start - 1] if start <= len(lines) else ""
    indent, balance, saw = len(first) - len(first.lstrip()), 0, False
    for n in range(start, len(lines) + 1):
        x = lines[n - 1]
        balance, saw = balance + x.count("{") - x.count("}"), saw or "{" in x
        if saw and balance <= 0 and n > start:
            return n
        if not saw and n > start and x.strip() and len(x) - len(x.lstrip()) <= indent and not x.strip().startswith(("@", "#", "//")):
            return n - 1
    return min(len(lines), start + 80)


def test_ends_against_the_walk():
    r = random.Random(1)
    for _ in range(3000):
        lines = ["".join(r.choice(["{", "}", "a", " ", "  ", "#", "// ", ""]) for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 14))]
        starts = [r.randint(1, len(lines) + 1) for _ in range(4)]
        assert spans.ends(lines, starts) == [walk(lines, s) for s in starts], (lines, starts)
    assert spans.ends([], [1]) == [0]


def test_ends_are_linear():
    lines = ["class A {", *("  function f() {" if k % 2 else "  }" for k in range(1, 20001)), "}"]
    at = time.perf_counter()
    found = spans.ends(lines, list(range(1, 20001)))
    assert found[0] == 20002 and found[1] == 3 and time.perf_counter() - at < 2
    deep = ["{" * 1] * 10000 + ["}"] * 10000
    assert spans.ends(deep, list(range(1, 10001))) == [20001 - k for k in range(1, 10001)]


def test_owners():
    kinds, starts, last = ["class", "function", "class", "function", "function"], [1, 2, 4, 5, 12], [10, 3, 8, 6, 13]
    assert spans.owners(kinds, starts, last) == [-1, 0, 0, 2, -1]


def test_go_blocks(spark):
    text = 'import "a"\nimport (\n\t"b"\n\tx "c"\n)\nvar s = "b"\nimport (\n  "d"\n)\nimport (\n"open"'
    found = spark.createDataFrame([(text,)], "t string").select(extract.go_imports(F.split("t", "\n", -1)).alias("i")).first().i
    assert [(i.name, i.line) for i in found] == [("a", 1), ("b", 3), ("c", 4), ("d", 8), ("open", 11)]


class Notes:
    """Lines that begin with a star as sections."""

    def eval(self, path: str, content: str):
        for n, line in enumerate((content or "").split("\n"), 1):
            if line.startswith("* "):
                yield "section", line[2:], f"{path}#{n}", n, n


def test_a_registered_language_yields_nodes(spark):
    files = spark.createDataFrame([("a.notes", "notes", "document", "* One\ntext\n* Two", "h"), ("b.notes", "notes", "document", None, "h"), ("c.md", "markdown", "document", "# Title", "h")], "path string, language string, category string, content string, content_hash string")
    registry = extensions.Registry(spark)
    assert registry.facts(files) is None
    registry.register("notes", Notes)
    nodes = extract.nodes(extensions.facts(files, registry))
    named = {(r.type, r.name, r.file_path) for r in nodes.collect()}
    assert {("section", "One", "a.notes"), ("section", "Two", "a.notes"), ("section", "Title", "c.md")} <= named
    assert embeddings.LocalHash().name != embeddings.DigestHash().name


def test_symbol_chunks_in_tasks_of_bounded_files(spark, monkeypatch):
    """Files with symbols and without are joined once, in tasks of so many files, and none is lost."""
    monkeypatch.setattr(chunking, "FILES", 2)
    files = spark.createDataFrame([(f"f{k}", f"a{k}\nb\nc") for k in range(20)], "path string, content string")
    nodes = spark.createDataFrame([(f"f{k}", "function", 2, 3) for k in range(0, 20, 2)] + [("f1", "module", 1, 3), ("gone", "class", 1, 1)], "file_path string, type string, line_start int, line_end int")
    found = chunking.symbols(files, nodes)
    assert {(r.path, r.line_start, r.line_end, r.content) for r in found.collect()} == {(f"f{k}", 1, 3, f"a{k}\nb\nc") if k % 2 else (f"f{k}", 2, 3, "b\nc") for k in range(20)}
    assert ", 10)" in found._jdf.queryExecution().executedPlan().toString()
