"""Unified diffs as frames: patch lines, hunks, changed lines, and the symbols they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def patch_lines(patches: DataFrame) -> DataFrame:
    """(patch_id, n, line) of (patch_id, patch)."""
    text = F.regexp_replace("patch", r"\r\n?", "\n")
    return patches.select("patch_id", F.posexplode(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)).alias("n", "line"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of hunks with their file, hunk number and line on the new side; a file header belongs to what follows it.

    Windows are over one patch, which is one commit's diff.
    """
    order = W.partitionBy("patch_id").orderBy("n")
    header = F.regexp_extract("line", HUNK, 3)
    named = F.trim(F.substr("line", F.lit(5)))
    path = F.when(F.startswith("line", F.lit("+++ ")), F.when(named == "/dev/null", "").otherwise(F.regexp_replace(named, "^b/", "")))
    marked = lines.select("*", path.alias("path_here"), (header != "").alias("is_hunk"), (F.startswith("line", F.lit("+++ ")) | F.startswith("line", F.lit("--- ")) | F.startswith("line", F.lit("diff --git "))).alias("is_head"))
    carried = marked.select(
        "*",
        F.coalesce(F.last("path_here", ignorenulls=True).over(order), F.lit("")).alias("file_path"),
        F.sum(F.col("is_hunk").cast("int")).over(order).alias("hunk"),
        F.last(F.when(F.col("is_hunk"), F.struct(*[F.regexp_extract("line", HUNK, k).alias(name) for k, name in enumerate(("old_start", "old_count", "new_start", "new_count"), 1)])), ignorenulls=True).over(order).alias("h"),
    ).where("hunk > 0 and not is_head")
    inside = W.partitionBy("patch_id", "hunk").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    kept = (~F.col("is_hunk") & ~F.startswith("line", F.lit("-"))).cast("int")
    number = lambda field, default: F.when(F.col(f"h.{field}") == "", default).otherwise(F.col(f"h.{field}")).cast("int")
    return carried.select(
        "patch_id", "n", "line", "file_path", "hunk", "is_hunk", number("old_start", 1).alias("old_start"), number("old_count", 1).alias("old_count"),
        number("new_start", 1).alias("new_start"), number("new_count", 1).alias("new_count"),
        (number("new_start", 1) + F.coalesce(F.sum(kept).over(inside), F.lit(0))).cast("int").alias("new_line"),
    )


def is_change(line: Column, new_line: Column) -> Column:
    return F.startswith(line, F.lit("+")) | (F.startswith(line, F.lit("-")) & (new_line > 0))


def hunks(lines: DataFrame) -> DataFrame:
    """One row a hunk with its changed new-side lines, in order, and its text. ``lines`` comes from ``numbered``."""
    line = F.struct("n", "line", "new_line", (~F.col("is_hunk") & is_change(F.col("line"), F.col("new_line"))).alias("changed"))
    by = lines.groupBy("patch_id", "file_path", "hunk", "old_start", "old_count", "new_start", "new_count").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    changed = F.transform(F.filter("ls", lambda x: x["changed"]), lambda x: x["new_line"])
    return by.withColumn("changed_lines", changed).withColumn("text", F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).drop("ls")


def touched_nodes(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, other than files, with a changed line (file_path, line) inside their span: a join on the file with a range filter."""
    spans = nodes.where("line_start is not null and line_end is not null and type <> 'file'")
    hit = spans.join(changes.select(F.col("file_path").alias("_path"), "line").distinct(), F.expr("file_path = _path and line between line_start and line_end"), "left_semi")
    return hit


def nodes_of_hunks(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(patch_id, file_path, new_start, node ids) of each hunk that touches any."""
    changed = found.select("patch_id", "file_path", "new_start", F.explode(F.array_distinct("changed_lines")).alias("line"))
    spans = nodes.where("line_start is not null and line_end is not null and type <> 'file'").select("id", F.col("file_path").alias("_path"), "line_start", "line_end")
    joined = changed.join(spans, F.expr("file_path = _path and line between line_start and line_end"))
    return joined.groupBy("patch_id", "file_path", "new_start").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def summary(lines: DataFrame) -> DataFrame:
    """Added and removed lines of each file."""
    body = lines.where("not is_hunk")
    return body.groupBy("file_path").agg(F.count_if(F.startswith("line", F.lit("+"))).alias("added"), F.count_if(F.startswith("line", F.lit("-"))).alias("removed"))


def last_before(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """As-of join: each probe (file, pos) with the name of the last symbol (file, pos, name) at or before it.

    Both sides are one stream in the order of positions, so no range join is needed; of
    symbols at one position the greatest name wins.
    """
    both = symbols.select("file", "pos", F.lit(0).alias("side"), "name", F.lit(None).cast("long").alias("probe")).unionByName(probes.select("file", "pos", F.lit(1).alias("side"), F.lit(None).cast("string").alias("name"), "probe"))
    order = W.partitionBy("file").orderBy("pos", "side", "name")
    return both.withColumn("name", F.last("name", ignorenulls=True).over(order)).where("side = 1").select("file", "pos", "probe", "name")


def innermost(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """Interval join: each probe (file, pos, probe) with the containing span (file, low, high, name) that starts last.

    A span is split into aligned cells of lengths 1, 2, 4 and so on, at most two of each, and a cell keeps the best
    of its spans only. A probe looks up the one cell of each length that holds it. So both sides grow with
    their own rows, not with the pairs, and a file with many spans is dealt out by its cells.
    """
    longest = spans.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    levels = F.sequence(F.lit(0), F.lit(int(longest or 0).bit_length()))
    first = lambda k: F.expr(f"shiftright(cast(low as bigint) + shiftleft(1l, {k}) - 1, {k})")
    last = lambda k: F.expr(f"shiftright(cast(high as bigint) + 1, {k}) - 1")
    each = spans.where("low <= high").select("file", "low", "high", "name", F.explode(levels).alias("k")).select("*", first("k").alias("a"), last("k").alias("b")).where("a <= b")
    # a cell is taken where the next longer one around it would reach beyond the span
    taken = F.array_compact(F.array(F.when(F.col("a") % 2 != 0, F.col("a")), F.when((F.col("b") % 2 == 0) & ~((F.col("a") % 2 != 0) & (F.col("a") == F.col("b"))), F.col("b"))))
    cells = each.select("file", "k", F.explode(taken).alias("cell"), "low", "name").groupBy("file", "k", "cell").agg(F.max(F.struct("low", "name")).alias("best"))
    asked = probes.select("file", "probe", F.col("pos").cast("long").alias("pos"), F.explode(levels).alias("k")).select("file", "probe", "k", F.expr("shiftright(pos, k)").alias("cell"))
    hit = asked.join(cells, ["file", "k", "cell"])
    return hit.groupBy("probe").agg(F.max("best").alias("m")).select("probe", F.col("m.name").alias("name"))
