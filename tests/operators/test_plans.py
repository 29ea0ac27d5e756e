import random

from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import chunking, diffs, graph, inference


def test_innermost_against_all_pairs(spark):
    r = random.Random(2)
    spans = [(f"f{r.randrange(3)}", low, low + r.choice([0, 1, 5, 40, 700]), f"s{k}") for k in range(300) for low in [r.randrange(1000)]]
    spans += [("f0", 5, 4, "backwards"), ("f1", 0, 1023, "whole")]
    probes = [(f"f{r.randrange(4)}", r.randrange(1800), k) for k in range(400)]
    found = diffs.innermost(spark.createDataFrame(probes, "file string, pos int, probe long"), spark.createDataFrame(spans, "file string, low int, high int, name string"))
    want = {}
    for f, p, k in probes:
        hit = [(low, n) for g, low, high, n in spans if g == f and low <= p <= high]
        if hit:
            want[k] = max(hit)[1]
    assert {x.probe: x.name for x in found.collect()} == want
    assert diffs.innermost(spark.createDataFrame(probes, "file string, pos int, probe long"), spark.createDataFrame([], "file string, low int, high int, name string")).collect() == []


def lengths(pairs, start):
    seen, at, d = {start: 0}, [start], 0
    while at:
        d += 1
        at = list({b for x in at for a, b in [*pairs, *((b, a) for a, b in pairs)] if a == x and b not in seen})
        seen |= dict.fromkeys(at, d)
    return seen


def test_paths_from_both_ends(spark):
    r = random.Random(6)
    pairs = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(44)] + [(f"c{k}", f"c{k + 1}") for k in range(8)]
    edges = spark.createDataFrame([(str(k), a, b, "x") for k, (a, b) in enumerate(pairs)], "id string, source_id string, target_id string, type string")
    linked = {frozenset(p) for p in pairs}
    one = lambda k: spark.createDataFrame([(k,)], "id string")
    for a, b in (("n1", "n2"), ("n3", "n17"), ("c0", "c6"), ("c0", "c8"), ("n5", "n5"), ("n1", "none")):
        path = [(x.step, x.id) for x in graph.shortest_path(one(a), one(b), edges).orderBy("step").collect()]
        far = lengths(pairs, a).get(b)
        if far is None or far > 6:
            assert path == []
            continue
        ids = [i for _, i in path]
        assert [s for s, _ in path] == list(range(far + 1)) and ids[0] == a and ids[-1] == b
        assert all(frozenset(p) in linked for p in zip(ids, ids[1:], strict=False))


def test_large_frontiers_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_IDS", 1)
    edges = spark.createDataFrame([("1", "a", "b", "x"), ("2", "c", "b", "x"), ("3", "d", "c", "x"), ("4", "b", "b", "x")], "id string, source_id string, target_id string, type string")
    nodes = spark.createDataFrame([(x,) for x in "abcdz"], "id string")
    seeds = nodes.where("id in ('a', 'z', 'c')")
    near, used = graph.neighbourhood(seeds, edges, nodes)
    assert {(x.id, x.hop) for x in near.collect()} == {("a", 0), ("c", 0), ("z", 0), ("b", 1), ("d", 1)} and {x.id for x in used.collect()} == {"1", "2", "3"}
    assert {(x.id, x.hop) for x in graph.impacted(nodes.where("id = 'b'"), edges, nodes, 3).collect()} == {("a", 1), ("c", 1), ("d", 2)}


def test_tests_by_the_stem_of_a_subject(spark):
    nodes = [("s", "function", "login", "src/auth.py"), ("o", "function", "login", "src/other.py"), ("t", "test", "test_login", "tests/xauthy/t.py"), ("u", "test", "test_it", "src/t.py")]
    found = inference.test_edges(spark.createDataFrame(nodes, "id string, type string, name string, file_path string")).collect()
    assert [(x.source_id, x.target_id) for x in found] == [("s", "t")]


def test_redaction_of_odd_line_ends(spark):
    texts = ["a\r\nb", "token=1\r\nx\n", "", "\n", "x\n\n", "PassWord: y\x0bz", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.redact(F.col("t")).alias("r")).collect()
    assert [x.r for x in rows] == ["a\nb", "token=<redacted>\nx", "", "", "x\n", "PassWord: <redacted>\nz", None]
    spans = chunking.windows(spark.createDataFrame([("p", "a\nsecret = 1\n\n \nb")], "path string, content string"), size=2)
    assert [(x.line_start, x.content) for x in spans.orderBy("line_start").collect()] == [(1, "a\nsecret=<redacted>"), (5, "b")]


def test_groups_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "GROUPED", 2)
    edges = spark.createDataFrame([(f"e{k}", f"n{k % 5}", f"n{k % 3}", "xy"[k % 2]) for k in range(20)], "id string, source_id string, target_id string, type string")
    rows = edges.collect()
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(6)], "id string")
    assert graph.dealt(edges, "id").rdd.getNumPartitions() == 10
    counted = graph.degrees(nodes, edges)
    assert {r.id: r.degree for r in counted.collect()} == {f"n{k}": sum(f"n{k}" in (e.source_id, e.target_id) for e in rows) for k in range(6)}
    assert "hashpartitioning(node" in counted._jdf.queryExecution().executedPlan().toString() and ", 20)" in counted._jdf.queryExecution().executedPlan().toString()
    want = {}
    for e in rows:
        want[e.source_id, e.target_id] = max(want.get((e.source_id, e.target_id), ("", "")), (e.id, e.type))
    assert len(want) < len(rows) and {(r.source_id, r.target_id): (r.id, r.type) for r in graph.last_per_pair(edges).collect()} == want
    alone = edges.where("id in ('e0', 'e1')")
    assert sorted(r.id for r in graph.last_per_pair(alone).collect()) == ["e0", "e1"]
