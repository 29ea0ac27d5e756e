"""Inferred edges: tests that name their subjects, and imports that name local modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions.ids import edge_id, stable_hash

SUBJECTS = ("function", "class", "api_endpoint", "module")
#: Endings tried for a relative import, in order.
MODULE_ENDINGS = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java")
INDEX_ENDINGS = ("ts", "tsx", "js", "jsx")


def test_subject(name: Column) -> Column:
    """What a test's name says it tests: affixes go one after the other, then ``_`` and ``-``."""
    out = F.lower(name)
    for prefix in ("test_", "test", "should_"):
        out = F.regexp_replace(out, f"^{prefix}", "")
    for suffix in ("_test", "test", "_spec", "spec"):
        out = F.regexp_replace(out, f"{suffix}$", "")
    return F.translate(out, "_-", "")


def grams(text: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda k: F.substring(text, k, F.lit(size))))


def test_edges(nodes: DataFrame) -> DataFrame:
    """``tested_by`` edges from subjects to tests whose name or path holds the subject's name, in the same area.

    A name inside a text shares its first three characters with the text at some place, so
    both sides are joined on those and on the area (the first directory). Where the subject's file stem stands inside
    the test's path, the join is on the whole stem, looked up among the path's parts of lengths that stems have.
    Only pairs with a common key are compared.
    """
    tests = nodes.where("type = 'test'").select(F.col("id").alias("test"), test_subject(F.col("name")).alias("said"), F.lower(F.coalesce("file_path", F.lit(""))).alias("test_path"), F.element_at(F.split(F.coalesce("file_path", F.lit("")), "/"), 1).alias("area"), F.col("file_path").alias("test_file"))
    subjects = nodes.where(F.col("type").isin(*SUBJECTS) & (F.length("name") >= 3) & F.col("file_path").isNotNull()).select(F.col("id").alias("subject"), F.lower("name").alias("named"), F.element_at(F.split("file_path", "/"), 1).alias("area"), F.lower(paths.stem(F.col("file_path"))).alias("stem"))
    probes = tests.select("*", F.explode(F.array_distinct(F.concat(grams(F.col("said")), grams(F.col("test_path"))))).alias("gram"))
    keyed = subjects.withColumn("gram", F.left("named", F.lit(3)))
    named = (F.contains("said", F.col("named")) | F.contains("test_path", F.col("named"))) & (F.col("subject") != F.col("test"))
    in_area = probes.join(keyed, ["gram", "area"]).where(named)
    lengths = subjects.where("stem <> ''").agg(F.collect_set(F.length("stem")).alias("lengths"))  # as many as lengths of file names
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.length("test_path") - n + 1, F.lit(1)))
    parts = F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.transform(starts(n), lambda k: F.substring("test_path", k, n)))))
    in_path = tests.crossJoin(F.broadcast(lengths)).select("test", "said", "test_path", "test_file", F.explode(parts).alias("stem"))  # with a single row
    by_stem = in_path.join(subjects.drop("area"), "stem").where(named)
    pairs = in_area.select("subject", "test", "test_file").union(by_stem.select("subject", "test", "test_file")).distinct()
    key = F.concat(F.lit("edge:"), stable_hash(F.col("subject"), F.col("test"), F.lit("tested_by"), F.lit("test-convention"), length=24))
    return pairs.select(key.alias("id"), F.col("subject").alias("source_id"), F.col("test").alias("target_id"), F.lit("tested_by").alias("type"), F.col("test_file").alias("file_path"))


def _joined_path(parent: Column, name: Column) -> Column:
    """parent/name with single dots gone and double dots kept."""
    return F.array_join(F.filter(F.split(F.concat_ws("/", parent, name), "/"), lambda p: (p != "") & (p != ".")), "/")


def candidates(imported: Column, source_file: Column) -> Column:
    """Module names to look for, best first."""
    cleaned = F.trim(F.regexp_replace(imported, "^external::", ""))
    dotted = F.trim(F.replace(cleaned, F.lit("/"), F.lit(".")), F.lit("."))
    parent = F.regexp_replace(source_file, "/?[^/]*$", "")
    local = F.trim(F.replace(_joined_path(parent, cleaned), F.lit("/"), F.lit(".")), F.lit("."))
    tried = F.concat(F.array(local), *[F.array(F.concat(local, F.lit(f".{e}"))) for e in MODULE_ENDINGS], *[F.array(F.concat(local, F.lit(f".index.{e}"))) for e in INDEX_ENDINGS])
    plain = F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.array(cleaned, dotted))
    return F.array_distinct(F.when(source_file.isNotNull() & F.startswith(cleaned, F.lit(".")), F.concat(plain, tried)).otherwise(plain))


def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges from importing modules to the local module that the first known candidate names.

    ``imports`` has source_id, target_id, imported, source_file; ``modules`` id, qualified_name.
    """
    tried = imports.select("source_id", "target_id", "imported", F.posexplode(candidates(F.col("imported"), F.col("source_file"))).alias("rank", "qualified_name"))
    known = tried.join(modules.select(F.col("id").alias("found"), "qualified_name"), "qualified_name")
    best = known.groupBy("source_id", "target_id", "imported").agg(F.min_by("found", F.struct("rank", "found")).alias("found")).where("found <> target_id and found <> source_id")
    key = edge_id(F.col("source_id"), F.col("found"), F.lit("imports"), F.concat(F.lit("local-import-resolver:"), F.col("imported")))
    return best.select(key.alias("id"), "source_id", F.col("found").alias("target_id"), F.lit("imports").alias("type"), "imported")


def resolved_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (file, caller, name) joined with the last definition (file, name, line, id) of that simple name; no self calls."""
    last = definitions.groupBy("file", "name").agg(F.max_by("id", F.struct("line", "id")).alias("callee"))
    simple = calls.withColumn("name", F.element_at(F.split("name", r"\."), -1))
    return simple.join(last, ["file", "name"]).where("caller <> callee").select("file", "caller", "callee").distinct()
