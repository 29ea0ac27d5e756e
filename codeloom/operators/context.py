"""What a context pack is made of: ordered seeds, searches that remember their way, sections under a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import BUDGETS, TRIM_MARK
from codeloom.operators import graph
from codeloom.operators.checkpoints import cut


def ordered_union(*sources: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    """Each id of several ranked sources once: at the place where it came first, with the values it came with last.

    The sources have the same columns; ``source`` and ``place`` of the result give its order.
    """
    each = reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(k)) for k, s in enumerate(sources)])
    at = F.struct("source", place)
    values = [c for c in sources[0].columns if c not in (key, place)]
    found = each.groupBy(key).agg(F.min(at).alias("first"), F.max(F.struct(at.alias("at"), *values)).alias("last"))
    return found.select(key, "first.source", F.col(f"first.{place}").alias(place), *[F.col(f"last.{c}").alias(c) for c in values])


def traced(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hop, rank, path) within ``depth`` undirected links of ranked seeds (id, rank).

    Searches from all seeds go on together. Where they meet, the fewest links win, then the seed with the
    least rank, then the least path, so every id carries one seed and the way from it.
    """
    # each edge is made once for both of its directions
    way = lambda here, there: F.struct(F.col(here).alias("here"), F.col(there).alias("there"))
    links = edges.select(F.inline(F.array(way("source_id", "target_id"), way("target_id", "source_id"))))
    frontier = cut(seeds.groupBy("id").agg(F.min("rank").alias("rank")).withColumn("path", F.array("id")))
    found = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        last = frontier.select(F.col("id").alias("here"), "rank", "path")
        reached = graph.met(links, last).where("there <> here").groupBy(F.col("there").alias("id")).agg(F.min(F.struct("rank", "path")).alias("best"))
        frontier = cut(reached.join(found.select("id"), "id", "left_anti").select("id", "best.rank", F.concat("best.path", F.array("id")).alias("path")))
        found = found.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return found.select("id", "hop", "rank", "path")


#: Kinds of nodes that a debugging order lists after the suspects.
CONFIGS = ("config", "resource", "pipeline")


def debug_order(suspects: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, tests: tuple[str, ...] = ("test",), configs: tuple[str, ...] = CONFIGS) -> DataFrame:
    """(kind, id, hop, rank, path): suspects (id, rank of their frame), then the tests and configurations around them, each with the frame and the way that reached it."""
    way = traced(suspects, edges, depth).join(nodes.select("id", "type"), "id")
    kind = F.when(F.col("hop") == 0, "suspect").when(F.col("type").isin(*tests), "test").when(F.col("type").isin(*configs), "config")
    return way.withColumn("kind", kind).where("kind is not null").select("kind", "id", "hop", "rank", "path")


def budget_chars(budget: str | int) -> int | None:
    """Characters that a token budget holds; None for all."""
    n = BUDGETS.get(budget, BUDGETS["normal"]) if isinstance(budget, str) else budget
    return None if n >= BUDGETS["full"] else max(256, 4 * n)


def fitted(lines: DataFrame, budget: str | int, request: str = "request", order: tuple[str, ...] = ("section", "place"), text: str = "text") -> DataFrame:
    """The lines of each request that its budget holds, the last of them cut and marked.

    The lines of a request are one text, joined by line ends; a text of more tokens than the budget (four
    characters each) is cut. Running sums of lengths go through the window, and texts are cut in their rows, so
    what is beyond the budget is dropped in the plan. Ties of the order go by the text.
    """
    most = budget_chars(budget)
    if most is None:
        return lines.select(request, *order, text)
    n = BUDGETS.get(budget, BUDGETS["normal"]) if isinstance(budget, str) else budget
    by = Window.partitionBy(request).orderBy(*order, text)
    sized = lines.withColumns({"_size": F.length(text).cast("long") + 1, "_whole": F.sum(F.length(text).cast("long") + 1).over(Window.partitionBy(request)) - 1})
    placed = sized.withColumn("_from", F.sum("_size").over(by) - F.col("_size"))
    fits = F.greatest(F.lit(1), F.floor(F.col("_whole") / 4)) <= n
    kept = placed.where(fits | (F.col("_from") < most))
    clipped = F.when(fits, F.col(text)).otherwise(F.left(text, F.greatest(F.lit(0), F.lit(most) - F.col("_from")).cast("int")))
    # white space at the cut goes, with whole lines of it; the mark follows the last line that is left
    bare = F.regexp_replace("_cut", r"\s+\z", "")
    told = kept.withColumn("_cut", clipped).withColumn("_end", F.max(F.when(F.length(bare) > 0, F.col("_from"))).over(Window.partitionBy(request)))
    ends = ~fits & (F.col("_from") == F.col("_end"))
    rows = told.where(fits | F.col("_end").isNull() | (F.col("_from") <= F.col("_end")))
    return rows.select(request, *order, F.when(ends, F.concat(bare, F.lit(TRIM_MARK))).otherwise(F.col("_cut")).alias(text))
