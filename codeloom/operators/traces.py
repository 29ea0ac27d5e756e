"""Stack frames out of error texts, by the grammar of each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language, pattern in Java's dialect, and the groups of path, line and function (0: none).
FRAMES = (
    ("python", r'File "([^"]+)", line (\d+), in ([^\s]+)', 1, 2, 3),
    ("node", r"\s*at\s+(?:([^\s(]+)\s+\()?(([\w./\\:-]+\.(?:js|ts|tsx|jsx)):(\d+):(\d+)\)?)", 3, 4, 1),
    ("java", r"\s*at\s+([\w.$<>]+)\(([^:()]+)(?::(\d+))?\)", 2, 3, 1),
    ("go", r"(?m)^\s*([\w./\\-]+\.(?:go|rs)):(\d+)(?::\d+)?", 1, 2, 0),
)
#: A path without a frame (longer endings first, as the first that fits is taken), and a line that names an error.
ANY_PATH = r"([\w./\\-]+\.(?:py|tsx|ts|jsx|js|go|rs|java))(?::(\d+))?"
ERROR = r"(?m)^([A-Za-z_.$][\w.$]*(?:Error|Exception|Panic|panic)):[^\S\n]*(.+)$"


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("issue", F.lit(pattern), F.lit(group)) if group else F.transform(F.regexp_extract_all("issue", F.lit(pattern), F.lit(0)), lambda x: F.lit(""))


def _matches(language: str, pattern: str, path: int, line: int, function: int) -> Column:
    zipped = F.arrays_zip(_all(pattern, path).alias("path"), _all(pattern, line).alias("line"), _all(pattern, function).alias("function"))
    return F.transform(
        zipped,
        lambda m: F.struct(
            F.regexp_replace(F.translate(m["path"], "\\", "/"), r"^(\./)+", "").alias("file_path"),
            F.when(m["line"] == "", None).otherwise(m["line"]).cast("int").alias("line"),
            F.when(m["function"] == "", None).otherwise(m["function"]).alias("function"),
            # Rust frames look like those of Go, and their paths tell them apart
            F.when(F.endswith(m["path"], F.lit(".rs")), "rust").otherwise(language).alias("language") if language == "go" else F.lit(language).alias("language"),
        ),
    )


def frames(issues: DataFrame, key: str = "id") -> DataFrame:
    """(key, place, file_path, line, function, language): frames of (key, issue) in order, each once.

    Paths without any frame around them count only where no grammar finds a frame.
    """
    known = F.flatten(F.array(*[_matches(*g) for g in FRAMES]))
    found = issues.select(key, "issue", known.alias("fs"))
    whole = F.when(F.size("fs") > 0, F.col("fs")).otherwise(_matches("unknown", ANY_PATH, 1, 2, 0))
    # a frame is the same whatever its language, so the first of each (path, line, function) stays
    bare = lambda f: F.struct(f["file_path"], f["line"], f["function"])
    once = found.select(key, whole.alias("fs")).withColumn("keys", F.transform("fs", bare))
    firsts = F.filter("fs", lambda f, k: F.array_position("keys", bare(f)) == k + 1)
    return once.select(key, F.posexplode(firsts).alias("place", "f")).select(key, "place", "f.*")


def errors(issues: DataFrame, key: str = "id") -> DataFrame:
    """(key, type, message) of the last error line of each issue."""
    last = lambda g: F.try_element_at(F.regexp_extract_all("issue", F.lit(ERROR), F.lit(g)), F.lit(-1))
    return issues.select(key, last(1).alias("type"), F.trim(last(2)).alias("message"))


def nodes_of_frames(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, other than files, whose span holds a frame's line."""
    at = found.where("line is not null").select(F.col("file_path").alias("_path"), F.col("line").alias("_line")).distinct()
    spans = nodes.where("type <> 'file' and line_start is not null")
    return spans.join(at, F.expr("file_path = _path and _line between line_start and coalesce(line_end, line_start)"), "left_semi")


def suspects(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, rank): nodes, other than files, whose span holds a frame's line, with the place of the first such frame."""
    at = found.where("line is not null").groupBy(F.col("file_path").alias("_path"), F.col("line").alias("_line")).agg(F.min("place").alias("place"))
    spans = nodes.where("type <> 'file' and line_start is not null")
    hit = spans.join(at, F.expr("file_path = _path and _line between line_start and coalesce(line_end, line_start)"))
    return hit.groupBy("id").agg(F.min("place").cast("int").alias("rank"))
