from pyspark.sql import functions as F

from codeloom.operators import overview

NODE = "id string, type string, name string, qualified_name string, file_path string"


def test_counts_and_lists(spark):
    nodes = spark.createDataFrame([("1", "module", "a", "a", "a.py"), ("2", "document", "d", "d", "d.md"), ("3", "function", "get_token", "a::get_token", "a.py"), ("4", "module", "x", "x", None)], NODE)
    edges = spark.createDataFrame([("e1", "1", "3", "contains"), ("e2", "1", "4", "imports")], "id string, source_id string, target_id string, type string")
    files = spark.createDataFrame([("a.py", "python", False, 1), ("d.md", None, None, 5), ("gone.py", "python", True, 9)], "path string, language string, is_deleted boolean, last_indexed_at int")
    assert overview.status(files=files, nodes=nodes, edges=edges).first().asDict() == {"files": 3, "nodes": 4, "edges": 2}
    assert overview.freshness(files).first().indexed_at == 5 and overview.freshness(files.limit(0)).first().indexed_at is None
    assert {(r.language, r.files) for r in overview.languages(files).collect()} == {("python", 1), ("unknown", 1)}
    assert overview.coverage(nodes).first().coverage == 25 and overview.coverage(nodes.limit(0)).first().coverage == 0
    assert [(r.file_path, r.n) for r in overview.important_files(nodes).collect()] == [("a.py", 2), ("d.md", 1)]
    assert {(r.path, r.nodes) for r in overview.files_with_counts(files, nodes).collect()} == {("a.py", 2), ("d.md", 1), ("gone.py", 0)}
    assert [r.id for r in overview.hotspots(nodes).collect()] == ["1", "3", "4"]
    assert [r.id for r in overview.exact(nodes, "a.py").orderBy("id").collect()] == ["1", "3"]
    assert overview.in_files(nodes, nodes.select("file_path").where("id = '2'")).count() == 1
    shown = overview.view(nodes, ("module", "function"), ring=2)
    assert [(r.id, r.ring, r.place) for r in shown.orderBy("id").collect()] == [("1", 0, 0), ("3", 0, 1), ("4", 1, 0)]
    assert [r.id for r in overview.view_edges(shown.where(F.col("id") != "4"), edges).collect()] == ["e1"]
