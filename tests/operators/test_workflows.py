import subprocess

from codeloom.operators import exports, graph, store, traces, workflows
from codeloom.streaming import updates, watch
from tests.operators.test_extract import FILES, tree


def graph_id(catalog, name):
    return catalog.read("nodes").where(f"qualified_name = '{name}'").first().id


def test_update_review_debug_and_exports(spark, tmp_path):
    root = tree(tmp_path / "r")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "-A"), git("commit", "-qm", "first")
    catalog = store.Catalog(spark, f"file://{tmp_path}/store")
    first = workflows.update(catalog, root)
    assert first["indexed"] == first["scanned"] == len(FILES) - 2
    assert first["embedded"] > 20 and workflows.update(catalog, root)["indexed"] == 0
    assert catalog.read("changes").count() == first["indexed"] and catalog.read("snapshots").count() == 1
    (tmp_path / "r/src/auth.py").write_text(FILES["src/auth.py"].replace("return 1", "return 2").replace("check(user)\n\n", "check(user or 1)\n\n"))
    (tmp_path / "r/db/schema.sql").write_text(FILES["db/schema.sql"] + "DROP TABLE users;\n")
    row = workflows.review(catalog, root).first()
    assert row.changed_files == ["db/schema.sql", "src/auth.py"]
    assert "src.auth.check" in row.changed_symbols
    assert [w.code for w in row.migration_warnings] == ["drop_table"]
    assert row.risk >= 35 and row.security_path and row.database_path
    assert row.warnings == [] and row.missing_tests == [] and row.affected_tests and row.diff_summary[0].startswith("db/schema.sql: +1/-0")
    assert [f.entry for f in row.impacted_flows] and row.prioritized_items[0].startswith("High-risk") and "explain db/schema.sql" in row.commands
    workflows.write_review(catalog, workflows.review(catalog, root))
    only = workflows.review(catalog, root, files=("main.go",)).first()
    assert only.changed_files == ["main.go"] and only.warnings and only.changed_lines == 0
    found = workflows.debug(catalog, 'Traceback\n  File "src/auth.py", line 6, in login\nValueError: x')
    assert "src.auth.Auth.login" in {r.qualified_name for r in found.around.where("kind = 'suspect'").collect()} and "src.auth.Auth.login" in found.pack
    assert found.steps[0] == "Open src/auth.py at line 6." and found.error.first().type == "ValueError"
    assert "tests.test_auth.test_login" in {r.qualified_name for r in found.around.where("kind = 'test'").collect()}
    tiny = workflows.explain(catalog, "src/auth.py", "tiny")
    assert len(tiny) <= 2800 + 40 and "src.auth" in tiny and "Semantic matches" in workflows.ask(catalog, "who checks the login", "full")
    memory = workflows.remember(catalog, "decision", "keep it\npassword = x")
    assert catalog.read("memories").first().content == "keep it\npassword=<redacted>"
    text, _ = workflows.handoff(catalog, root)
    assert "- `src/auth.py`" in text and "keep it" in text and "first" in text and catalog.read("sessions").count() == 1
    assert workflows.forget(catalog, memory) and not workflows.forget(catalog, memory) and catalog.read("memories").count() == 0
    workflows.wiki(catalog, f"{tmp_path}/wiki")
    assert "# src/auth.py" in {r.value for r in spark.read.text(f"{tmp_path}/wiki").collect()}
    assert all(r.ok for r in workflows.doctor(catalog).collect()), workflows.doctor(catalog).collect()
    assert store.provenance_of(catalog.read("provenance"), graph_id(catalog, "src.auth.check")).first().source_path == "src/auth.py"
    exports.write_graphml(catalog.read("nodes"), catalog.read("edges"), f"{tmp_path}/g")
    assert spark.read.text(f"{tmp_path}/g").count() > 20
    assert "# Onboarding" in workflows.onboarding(catalog)


def test_shortest_path_and_neighbourhood_on_small_graphs(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "x"), ("e2", "b", "c", "x"), ("e3", "d", "c", "x"), ("e4", "a", "a", "x")], "id string, source_id string, target_id string, type string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("z",)], "id string")
    one = lambda k: nodes.where(f"id = '{k}'")
    path = lambda a, b, **kw: [r.id for r in graph.shortest_path(one(a), one(b), edges, **kw).orderBy("step").collect()]
    assert path("a", "d") == ["a", "b", "c", "d"] and path("a", "d", cutoff=2) == [] and path("a", "z") == [] and path("a", "a") == ["a"]
    near, used = graph.neighbourhood(one("a"), edges, nodes)
    assert {r.id for r in near.collect()} == {"a", "b"} and {r.id for r in used.collect()} == {"e1", "e4"}
    assert {r.id: r.degree for r in graph.degrees(nodes, edges).collect()} == {"a": 2, "b": 2, "c": 2, "d": 1, "z": 0}


def test_stack_traces(spark):
    issues = [(1, 'File "src/app.py", line 3, in run\nFile "src/app.py", line 3, in run'), (2, "    at login (src/auth.ts:10:5)\n  at com.a.B.go(B.java:7)"), (3, "see src/x.rs:4 and y.py")]
    got = [(r.id, r.file_path, r.line, r.function, r.language) for r in traces.frames(spark.createDataFrame(issues, "id long, issue string")).orderBy("id", "place").collect()]
    assert got == [(1, "src/app.py", 3, "run", "python"), (2, "src/auth.ts", 10, "login", "node"), (2, "B.java", 7, "com.a.B.go", "java"), (3, "src/x.rs", 4, None, "unknown"), (3, "y.py", None, None, "unknown")]


def test_throttle_batch(spark):
    rows = [("a", 0.0), ("a", 0.5), ("a", 1.2), ("a", 1.9), ("a", 2.3), ("b", 0.1), (None, 5.0), (None, 5.5)]
    rows += [("many", k / 10) for k in range(1000)]
    frame = spark.createDataFrame(rows, "key string, ts double")
    want, last = set(), {}
    for k, t in sorted(rows, key=lambda r: r[1]):
        if k not in last or t - last[k] >= 1.0:
            last[k] = t
            want.add((k, t))
    assert {tuple(r) for r in watch.throttle(frame).collect()} == want
    assert watch.throttle(frame.limit(0)).collect() == []


def test_throttle_stream_and_expiry(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, "key string, ts double").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        stream = spark.readStream.schema("key string, ts double").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = []
        q = watch.watch(watch.throttle_stream(stream), lambda df, _: out.extend(tuple(r) for r in df.collect()), f"{tmp_path}/cp")
        q.awaitTermination(120)
        return set(out), q.lastProgress["stateOperators"][0]["numRowsTotal"]

    put(0, [("a", 10.0), ("a", 10.5), ("a", 11.2), ("a", 11.9), ("a", 12.3), ("b", 10.1)])
    assert run()[0] == {("a", 10.0), ("a", 11.2), ("a", 12.3), ("b", 10.1)}
    put(1, [("a", 13.0), ("a", 13.4), ("b", 12.9)])  # the state goes on after a restart
    assert run()[0] == {("a", 13.4), ("b", 12.9)}
    put(2, [("z", 100.0)])
    found, left = run()
    assert found == {("z", 100.0)} and left <= 2  # only what belongs to the newest key: its value and its timer
    put(3, [("a", 101.5)])
    found, left = run()
    assert found == {("a", 101.5)} and left <= 2  # the others are forgotten


def event(path, content, seq, status="M"):
    return (path, status, content, "code", "typescript", str(len(content or "")), seq)


def test_batches_merge_once_and_replays_change_nothing(spark, tmp_path):
    root = f"{tmp_path}/log"
    run = updates.updater(root)
    batch = lambda *rows: spark.createDataFrame(list(rows), updates.EVENT)
    first = batch(event("src/auth.ts", "function login() {\n}\n", 1), event("src/auth.ts", "function login() {\n}\nfunction logout() {\n}\n", 2), event("src/gone.ts", "class Gone {\n}\n", 3))
    second = batch(event("tests/test_login.ts", "function test_login() {\n}\n", 1), event("src/gone.ts", None, 2, "D"))
    third = batch(event("src/auth.ts", "function login() {\n  x()\n}\n", 1))
    names = lambda: sorted(r.name for r in updates.current(spark, root, "nodes").where("type in ('function', 'class', 'test')").collect())
    run(first, 0)
    assert names() == ["Gone", "login", "logout"]
    run(second, 1)
    assert names() == ["login", "logout", "test_login"]
    inferred = lambda: sorted((r.source_id, r.target_id) for r in updates.current(spark, root, "edges").where("confidence_tier = 'inferred'").collect())
    assert len(inferred()) >= 1
    state = lambda: {t: sorted(map(str, updates.current(spark, root, t).collect())) for t in updates.TABLES}
    before = state()
    run(second, 1)
    assert state() == before
    assert [r.is_deleted for r in updates.current(spark, root, "files").orderBy("path").collect()] == [False, True, False]
    run(third, 2)
    assert names() == ["login", "test_login"] and len(inferred()) >= 1
    assert updates.current(spark, root, "changes").count() == 6
    assert updates.current(spark, f"{tmp_path}/none", "nodes").count() == 0
