from codeloom.operators import embeddings, lookups

NODE = "id string, type string, name string, qualified_name string, file_path string, confidence_tier string, summary string, tags array<string>, metadata string"


def nodes(spark):
    return spark.createDataFrame(
        [
            ("1", "function", "login", "auth::login", "auth.py", "extracted", "Signs in", ["a", "b"], '{"x": "said", "n": 3}'),
            ("2", "class", "_Hidden", "core::_Hidden", "core.py", "extracted", None, None, None),
            ("3", "document", "", "", None, "extracted", None, None, "no json"),
        ],
        NODE,
    )


def test_records_and_semantic_search(spark):
    records = lookups.node_records(nodes(spark))
    assert {r.entity_id: r.text for r in records.collect()} == {"1": "function login auth::login Signs in a b said", "2": "class _Hidden core::_Hidden", "3": "document"}
    rows = embeddings.embedded(embeddings.marked(records, embeddings.LocalHash()), embeddings.LocalHash())
    found = embeddings.semantic(rows, "login auth", 1).collect()
    assert [r.entity_id for r in found] == ["1"] and found[0].score > 0
    assert embeddings.semantic(rows, "  ").count() == 0


def test_review_lists(spark):
    files = spark.createDataFrame([("src/API.py",), ("a/jwt.toml",), ("Dockerfile",), ("db/x.sql",)], "path string")
    of = lambda rows: sorted(r.item for r in rows.collect())
    assert of(lookups.public_changes(files, nodes(spark))) == ["auth::login", "src/API.py"]
    assert of(lookups.config_changes(files)) == ["Dockerfile", "a/jwt.toml"]
    assert of(lookups.database_changes(files, nodes(spark))) == ["db/x.sql"]
    assert of(lookups.security_changes(files, nodes(spark))) == ["a/jwt.toml", "auth::login"]


def test_priorities(spark):
    flags = ", ".join(f"{flag} boolean" for flag, _ in lookups.PRIORITIES)
    rows = spark.createDataFrame([([], *[False] * 6), (None, *[True] * 6), (["b", "a", "b"], *[None] * 6)], f"high array<string>, {flags}")
    got = [r["items"] for r in lookups.priorities(rows).collect()]
    assert got[0] == [lookups.NO_PRIORITY] and got[1] == [text for _, text in lookups.PRIORITIES]
    assert len(got[2]) == 1 and "(a, b)" in got[2][0]


def test_small_lookups(spark):
    assert [(r.id, r.bullet) for r in lookups.bullets(nodes(spark), "login").collect()] == [("1", "- function `auth::login`")]
    assert [r.id for r in lookups.in_file_order(nodes(spark).selectExpr("*", "1 as line_start"), ["core.py", "auth.py"]).collect()] == ["2", "1", "3"]
    assert lookups.in_file_order(nodes(spark).selectExpr("*", "1 as line_start"), []).count() == 3
    edges = spark.createDataFrame([("e", "1", "1"), ("f", "1", "2")], "id string, source_id string, target_id string")
    assert [tuple(r) for r in lookups.flow_counts(nodes(spark).where("id <> '2'"), edges).collect()] == [("1", 2, 2)]
    chunk = lookups.whole_files(spark.createDataFrame([("a", "x\ny"), ("b", None)], "path string, content string")).orderBy("file_path").collect()
    assert [(c.line_end, c.content, c.token_estimate) for c in chunk] == [(2, "x\ny", 1), (1, "", 1)]
