"""Connected components by alternating large and small stars over edges that each task has first thinned out.

A task joins the edges it holds and passes on one edge a node to the least node that these edges reach, so of the links
inside a large group, whose number may grow with the square of the group, it keeps fewer than the group has nodes. Edges
are held in partitions of ``EDGES`` each, however many there are and as their number falls, so that a small graph isn't
dealt out to as many tasks as the session has for large shuffles; one partition's edges need no stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, hot_join

#: Edges of one partition, 2 MB for keys of 16 bytes.
EDGES = 1 << 16


def _least_ends(edges: dict, u: object) -> object:
    """The end of u's way through ``edges``, which is halved."""
    while (v := edges.get(u, u)) != u:
        edges[u] = u = edges.get(v, v)
    return u


def _thinned(edges: DataFrame, most: int) -> DataFrame:
    """Edges (u, v), u > v, that join the same nodes: of those a task holds, one from each node to the least one they reach; of so many nodes at once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(least), kind), pa.array([_least_ends(least, u) for u in list(least)], kind)], ["u", "v"])
        for b in batches:
            kind = b.column(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = _least_ends(least, u), _least_ends(least, v)
                if u != v:
                    least[max(u, v)] = min(u, v)
            if len(least) > most:
                yield made()
                least.clear()
        if least:
            yield made()

    edges = edges.select("u", "v").where("u <> v")
    return edges.mapInArrow(work, edges.schema)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
    return hot_join(both, least, "u", "n", 2 * total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    moved = hot_join(down, least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _is_starry(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser one, or only edges to greater ones."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n")).where("down > 1 or down = 1 and n > 1").isEmpty()


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is the least node of its component."""
    now = cut(_thinned(edges, 4 * per_task))
    while True:
        tasks = -(-max(now.count(), 1) // per_task)
        placed = cut(_thinned(now.coalesce(tasks), 4 * per_task))
        if tasks == 1 or _is_starry(placed):
            break
        n = placed.count()
        now = cut(_small_star(cut(_large_star(placed, n)), n).where("u <> v").distinct())
    stars = placed.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())
