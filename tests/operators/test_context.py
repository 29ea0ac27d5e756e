import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.functions.text import BUDGETS, TRIM_MARK
from codeloom.operators import context, graph, inverted, store

EDGE = "id string, source_id string, target_id string, type string"


def test_ordered_union_keeps_the_first_place_and_the_last_value(spark):
    one = spark.createDataFrame([("b", 0, "b0"), ("a", 1, "a0")], "id string, place int, v string")
    two = spark.createDataFrame([("c", 0, "c1"), ("a", 2, "a1")], "id string, place int, v string")
    three = spark.createDataFrame([("b", 5, "b2"), ("a", 0, "a2"), ("a", 4, "a2 again"), ("d", 1, None)], "id string, place int, v string")
    rows = context.ordered_union(one, two, three).orderBy("source", "place").collect()
    assert [(r.id, r.v) for r in rows] == [("b", "b2"), ("a", "a2 again"), ("c", "c1"), ("d", None)]
    assert context.ordered_union(one.limit(0)).count() == 0


def brute_traced(seeds, edges, depth):
    best = {i: (0, r, [i]) for i, r in sorted(seeds, key=lambda s: -s[1])}
    for hop in range(1, depth + 1):
        new = {}
        for here, (h, r, path) in best.items():
            if h == hop - 1:
                for a, b in [*edges, *((b, a) for a, b in edges)]:
                    if a == here and b not in best and b != here:
                        new[b] = min(new.get(b, (r, path)), (r, path))
        best |= {i: (hop, r, [*p, i]) for i, (r, p) in new.items()}
    return sorted((i, h, r, p) for i, (h, r, p) in best.items())


def test_searches_that_meet_keep_one_way(spark):
    r = random.Random(3)
    pairs = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)]
    seeds = [("n1", 2), ("n2", 0), ("n3", 1), ("n1", 5), ("lone", 9)]
    edges = spark.createDataFrame([(str(k), a, b, "calls") for k, (a, b) in enumerate(pairs)], EDGE)
    found = context.traced(spark.createDataFrame(seeds, "id string, rank int"), edges, 3).collect()
    assert sorted((x.id, x.hop, x["rank"], x.path) for x in found) == brute_traced([("n1", 2), *seeds[1:3], seeds[4]], pairs, 3)


def test_large_frontiers_meet_links_at_their_own_types_only(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_IDS", 0)
    links = spark.createDataFrame([("a:1", "b:1"), ("a:2", "b:2"), ("b:1", "a:1"), ("a", "b:3")], "here string, there string")
    for ids, want in ((["a:1", "a:3"], ["b:1"]), (["a", "b:1"], ["a:1", "b:3"]), ([f"k{k}:1" for k in range(graph.KINDS)] + ["a:2"], ["b:2"])):
        got = graph.met(links, spark.createDataFrame([(i,) for i in ids], "here string")).collect()
        assert sorted(r.there for r in got) == want
    test_searches_that_meet_keep_one_way(spark)


def test_debug_order(spark):
    nodes = spark.createDataFrame([("s", "function"), ("t", "test"), ("c", "config"), ("o", "class")], "id string, type string")
    edges = spark.createDataFrame([("1", "s", "t", "tested_by"), ("2", "o", "s", "calls"), ("3", "o", "c", "configures")], EDGE)
    rows = context.debug_order(spark.createDataFrame([("s", 4)], "id string, rank int"), edges, nodes).collect()
    assert sorted((r.kind, r.id, r.hop, r["rank"], r.path) for r in rows) == [("config", "c", 2, 4, ["s", "o", "c"]), ("suspect", "s", 0, 4, ["s"]), ("test", "t", 1, 4, ["s", "t"])]


def trimmed(texts, budget):
    n = BUDGETS.get(budget, 4000) if isinstance(budget, str) else budget
    whole = "\n".join(texts)
    if n >= BUDGETS["full"] or max(1, len(whole) // 4) <= n:
        return whole
    return whole[: max(256, 4 * n)].rstrip() + TRIM_MARK


@pytest.mark.parametrize("budget", ["tiny", "normal", "full", 64, 1, 100])
def test_lines_under_a_budget(spark, budget):
    r = random.Random(7)
    texts = {}
    for k in range(12):
        texts[f"r{k}"] = ["x" * r.choice([0, 1, 30, 200, 700]) + " " * r.choice([0, 0, 3, 300]) for _ in range(r.choice([1, 3, 8, 40]))]
    texts["edge"] = ["y" * 255, "z" * 10, "w" * 2000]
    lines = spark.createDataFrame([(q, k % 2 if q == "none" else 0, k, t) for q, ts in texts.items() for k, t in enumerate(ts)], "request string, section int, place int, text string")
    rows = sorted(context.fitted(lines, budget).collect())
    for q, ts in texts.items():
        assert "\n".join(x.text for x in rows if x.request == q) == trimmed(ts, budget), q


def test_index_prunes_buckets_and_finds_phrases(spark, tmp_path):
    rows = spark.createDataFrame([("1", "read the file", "auth::login"), ("2", "the read file file", "core"), ("3", None, "file the read"), ("4", "", "")], "id string, name string, q string")
    inverted.write(inverted.postings(rows, "id", {"name": F.col("name"), "q": F.col("q")}), str(tmp_path / "i"))
    index = inverted.read(spark, str(tmp_path / "i"))
    of = lambda q, **kw: sorted(r.id for r in inverted.search(index, q, **kw).collect())
    assert of("read-the") == ["1"] and of("the-read") == ["2", "3"] and of("file-file") == ["2"] and of("auth::login") == ["1"]
    assert of("nothing login") == ["1"] and of("file", fields=("q",)) == ["3"] and of("") == of('"": /') == []
    plan = inverted.search(index, "login")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_graph_search_falls_back_to_parts_of_words(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "login", "auth::login", "a.py"), ("n2", "relogin", "auth::relogin", "b.py")], "id string, name string, qualified_name string, file_path string")
    chunks = spark.createDataFrame([("c1", "call login now", "a.py"), ("c2", "nothing", "login.py")], "id string, content string, file_path string")
    made = []
    for name, rows, fields in (("n", nodes, ("name", "qualified_name")), ("c", chunks, ("content",))):
        inverted.write(inverted.postings(rows, "id", {f: F.col(f) for f in fields}), str(tmp_path / name))
        made.append(inverted.read(spark, str(tmp_path / name)))
    of = lambda q: sorted((r.kind, r.id, r.source) for r in inverted.search_graph(nodes, chunks, *made, q).collect())
    assert of("login") == [("chunk", "c1", 2), ("node", "n1", 0)]
    assert of("ogin") == [("chunk", "c1", 2), ("chunk", "c2", 2), ("node", "n1", 1), ("node", "n2", 1)]


def test_provenance_merge_and_lookup(spark):
    kinds = "entity_id string, entity_type string, source string, source_path string, line_start int, line_end int, confidence_tier string, metadata string, created_at timestamp"
    day = lambda d: datetime(2024, 1, d)
    said = spark.createDataFrame([("e", "node", "x", "a.py", 1, 2, "extracted", "m1", day(1)), ("e", "node", "x", "a.py", 1, 2, "inferred", "m2", day(2)), ("e", "node", "x", None, None, None, "extracted", None, day(1)), ("f", "chunk", "x", "a.py", 1, 2, "extracted", None, day(1))], kinds)
    empty = spark.createDataFrame([], store.TABLES["provenance"])
    once = store.merge_provenance(empty, said)
    assert once.columns == empty.columns and once.count() == 3
    more = spark.createDataFrame([("e", "edge", "x", "a.py", 1, 2, "ambiguous", None, day(9)), ("e", "node", "x", "b.py", 1, 2, "extracted", None, day(5))], kinds)
    twice = store.merge_provenance(once, more)
    rows = store.provenance_of(twice, "e").collect()
    assert [(r.source_path, r.confidence_tier, r.metadata, r.created_at.day, r.entity_type) for r in rows] == [("b.py", "extracted", None, 5, "node"), *sorted([("a.py", "ambiguous", None, 1, "node"), (None, "extracted", None, 1, "node")], key=lambda t: next(r.id for r in rows if r.source_path == t[0]))]
    assert store.merge_provenance(twice, more).exceptAll(twice).count() == 0 and len(store.provenance_of(twice, "e", 1).collect()) == 1


def test_postings_shuffle_rows_only(spark, monkeypatch):
    """One shuffle, of the rows; words of several slices and tasks keep their rows and places."""
    monkeypatch.setattr(inverted, "ROWS", 2)
    monkeypatch.setattr(inverted, "CHARS", 8)
    rows = spark.createDataFrame([(k, f"a b{k} a" if k % 3 else None, "b") for k in range(11)], "id long, t string, u string")
    found = inverted.postings(rows, "id", {"t": F.col("t"), "u": F.col("u")})
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and found.rdd.getNumPartitions() > 4
    want = {(k, "u", "b"): [0] for k in range(11)}
    for k in range(11):
        if k % 3:
            want |= {(k, "t", "a"): [0, 2], (k, "t", f"b{k}"): [1]}
    got = found.collect()
    assert {(r.id, r.field, r.term): r.positions for r in got} == want and len(got) == len(want)
