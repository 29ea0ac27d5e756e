from pyspark.sql import functions as F

from codeloom.operators import memories, reports, review, store, workflows
from codeloom.plans import context_queries

NODE = "id string, type string, name string, qualified_name string, file_path string, line_start int, line_end int, confidence_tier string"
EDGE = "id string, source_id string, target_id string, type string"


def world(spark):
    nodes = spark.createDataFrame(
        [
            ("f1", "function", "login", "auth::login", "auth.py", 1, 9, "extracted"), ("f2", "function", "_hide", "auth::_hide", "auth.py", 11, 19, "ambiguous"), ("m", "module", "auth", "auth", "auth.py", 1, 30, "extracted"),
            ("c", "class", "Page", "page::Page", "page.py", 1, 5, "extracted"), ("t", "test", "test_login", "t::test_login", "tests/t.py", 1, 3, "extracted"), ("d", "database_table", "users", "database::users", None, None, None, "extracted"),
        ],
        NODE,
    )
    edges = spark.createDataFrame([("1", "c", "f1", "calls"), ("2", "f1", "t", "tested_by"), ("3", "f1", "d", "reads_from"), ("4", "f1", "f1", "calls")], EDGE)
    return nodes, edges


def run(spark, files, patches=(), churn=()):
    files = spark.createDataFrame(files, "change long, path string, place int")
    return review.review(files, spark.createDataFrame(list(patches), "change long, path string, patch string"), spark.createDataFrame(list(churn), "change long, path string, commits int"), *world(spark))


def test_changes_are_reviewed_side_by_side(spark):
    patch = "+++ b/auth.py\n@@ -2,1 +2,2 @@\n+a\n+b\n"
    rows = run(spark, [(1, "auth.py", 0), (2, "page.py", 0), (2, "deploy.yml", 1), (3, "db/migrations/x.sql", 0)], [(1, "auth.py", patch), (3, "db/migrations/x.sql", "+++ b/db/migrations/x.sql\n@@ -0,0 +1 @@\n+DROP TABLE users;\n"), (9, "none", patch)], [(1, "auth.py", 4), (2, "page.py", 3), (2, "deploy.yml", 3)])
    one, two, three = (r.asDict() for r in rows.orderBy("change").collect())
    assert one["changed_symbols"] == ["auth::login"] and one["impacted_files"] == ["page.py"] and one["affected_tests"] == ["tests/t.py"]
    assert one["missing_tests"] == [] and one["churn"] == 4 and one["changed_lines"] == 2 and one["warnings"] == []
    assert one["diff_summary"] == ["auth.py: +2/-0 lines in available diff."]
    assert [(f.entry, f.node_count, f.edge_count) for f in one["impacted_flows"]] == [("auth::login", 4, 4)]
    assert two["changed_symbols"] == [] and two["nodes"] == 1 and two["churn"] == 6 and two["warnings"] == [review.NO_DIFF] and review.CHECK_CONFIG in two["checklist"]
    assert two["impacted_flows"][0].entry == "page::Page" and two["missing_tests"] == [review.NO_TESTS]
    assert three["migration_warnings"][0].code == "drop_table" and three["prioritized_items"][0].startswith("High-risk") and three["database_or_schema_changes"] == ["db/migrations/x.sql"]
    assert three["impacted_flows"] is None or three["impacted_flows"] == []
    text = {r.change: r.text for r in review.markdown(rows).collect()}
    assert "## Changed symbols\n- `auth::login`" in text[1] and "## Warnings" in text[2] and "- Database/schema: `db/migrations/x.sql`" in text[3] and "- [ ] " in text[1]


def test_no_change_gives_no_row(spark):
    assert run(spark, []).collect() == []


def test_long_patches_are_cut(spark):
    frame = spark.createDataFrame([("\n".join(f"+{k}" for k in range(5)) + "\n",), ("+a",), (None,)], "p string")
    assert [r.s for r in frame.select(review.snippet(F.col("p"), 3).alias("s")).collect()] == ["+0\n+1\n+2\n... truncated 2 diff lines ...", "+a", None]


def test_reports_and_wiki(spark, tmp_path):
    assert reports.latest_report(spark, str(tmp_path), "x").collect() == []
    for text in ("old", "new"):
        reports.write_report(spark.createDataFrame([(text, "{}")], "text string, payload string"), "x", str(tmp_path))
    assert reports.latest_report(spark, str(tmp_path), "x").first().text == "new"
    nodes, edges = world(spark)
    files = spark.createDataFrame([("auth.py", "python", False), ("gone.py", None, True)], "path string, language string, is_deleted boolean")
    said = spark.createDataFrame([("decision", "use it"), ("note", "no")], "kind string, content string").withColumn("created_at", F.current_timestamp())
    kept = memories.remember(spark.createDataFrame([], store.TABLES["memories"]), said)
    pages = {r.page: r.text for r in reports.wiki_pages(files, nodes, edges, kept, reports.latest_report(spark, str(tmp_path), "x")).collect()}
    assert pages["files/auth_py"].endswith("- Node count: 3") and "files/gone_py" not in pages and pages["review"] == "new"
    assert "`auth::login` --calls--> `auth::login`" in pages["flows"] and "- **decision**: use it" in pages["decisions"] and "note" not in pages["decisions"]
    assert [r.page for r in reports.index_pages(files).collect()] == ["index"]
    many = spark.range(25).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit(None).cast("string").alias("language"), F.lit(False).alias("is_deleted"))
    assert sum(r.text.count("\n- [p") for r in reports.index_pages(many, 10).collect()) == 25


def test_memories_and_sessions(spark):
    empty = spark.createDataFrame([], store.TABLES["memories"])
    said = spark.createDataFrame([("note", "a\ntoken: x", "2024-01-01"), ("note", "a\ntoken: x", "2024-01-01"), ("task", None, "2024-01-02")], "kind string, content string, at string").withColumn("created_at", F.to_timestamp("at"))
    kept = memories.remember(empty, said)
    assert sorted((r.kind, r.content, r.redacted) for r in kept.collect()) == [("note", "a\ntoken: <redacted>", True), ("task", "", False)]
    assert memories.remember(kept, said).count() == 2 and memories.listed(kept, ("task",)).first().kind == "task"
    assert memories.forget(kept, kept.where("kind = 'task'")).count() == 1
    talks = memories.session_rows(spark.createDataFrame([("handoff", "t", "s", "2024-01-01"), ("handoff", "t", "s", "2024-01-03")], "kind string, title string, summary string, at string").withColumn("created_at", F.to_timestamp("at")))
    assert [r.created_at.day for r in memories.recent_sessions(talks, 1).collect()] == [3]


def test_recent_sessions_of_like_parts(spark, tmp_path):
    """Parts that agree in name, brand and day are rows of their own."""
    spark.createDataFrame([(299 + 300 * k, "n", "b") for k in range(4)] + [(5, "m", "b")], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert [r.title for r in context_queries.q_recent_sessions(spark, str(tmp_path)).collect()] == ["n"] * 4 + ["m"]


def test_todo(spark):
    rows = workflows.todo(spark.createDataFrame([("b", "x\n # todo: y"), ("a", "FIXME")], "path string, content string")).collect()
    assert [(r.path, r.line, r.text) for r in rows] == [("a", 1, "FIXME"), ("b", 2, "# todo: y")]
