"""Graph operators: breadth-first searches as frontier joins, and degree-like aggregates.

Frames: ``nodes`` with ``id``, ``edges`` with ``id, source_id, target_id, type``. Frontiers
are counted and broadcast while they are small, so edges stay where they are; edges are never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.checkpoints import cut


#: A frontier of at most so many ids is broadcast: some megabytes.
BROADCAST_IDS = 50_000


def near(frontier: DataFrame) -> DataFrame:
    """A stored frontier, marked for broadcast after its rows were counted; a larger one is shuffled."""
    return F.broadcast(frontier) if frontier.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else frontier


#: Ids begin with their node's type; a frontier of more than so many beginnings isn't told by them.
KINDS = 64


def met(links: DataFrame, frontier: DataFrame) -> DataFrame:
    """The links at a stored frontier (here, ...). If it is too large for a broadcast, links at other types of nodes are left out before the rest is shuffled."""
    close = frontier.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    if close:
        return links.join(F.broadcast(frontier), "here")
    kind = F.substring_index("here", ":", 1)
    kinds = [r.kind for r in frontier.select(kind.alias("kind")).distinct().limit(KINDS + 1).collect()]
    return (links.where(kind.isin(kinds)) if len(kinds) <= KINDS else links).join(frontier, "here")


#: Rows that one task groups: their strings take some hundred megabytes.
GROUPED = 1 << 20


def dealt(rows: DataFrame, *keys: str, n: int | None = None, per_task: int | None = None) -> DataFrame:
    """The rows by their keys in as many tasks as hold ``GROUPED`` each, or ``per_task``, however many tasks the session has for shuffles; ``n`` is their number, if known."""
    n = rows.count() if n is None else n
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (per_task or GROUPED))), *keys)


def _step(frontier: DataFrame, links: DataFrame, seen: DataFrame) -> DataFrame:
    """Ids one link beyond the frontier that weren't seen. ``links`` has ``here`` and ``there``."""
    reached = links.join(near(frontier.select(F.col("id").alias("here"))), "here", "left_semi").select(F.col("there").alias("id")).distinct()
    return reached.join(seen.select("id"), "id", "left_anti")


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there")).union(_reverse(edges))


def _narrow(links: DataFrame) -> DataFrame:
    """The links alone, written once, so that each hop of a deep search reads two columns; they stay where they are, as a hub's links are many."""
    return cut(links.select("here", "there"))


#: Searches of more hops write their links first; others read the edges once a hop.
FEW_HOPS = 2


def reach(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(id, hop) within ``depth`` links of the seeds, which have hop 0."""
    links = _narrow(links) if depth > FEW_HOPS else links
    frontier = cut(seeds.select("id").distinct())
    found = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        frontier = cut(_step(frontier, links, found))
        found = found.union(frontier.withColumn("hop", F.lit(hop)))
    return found


def impacted(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, types: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that depend on the seeds, directly or over others, with their hop; seeds aren't among them."""
    used = edges.where(F.col("type").isin(*types)) if types else edges
    found = reach(seeds, _reverse(used), depth).where("hop > 0")
    return nodes.join(found, "id")


def neighbourhood(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` undirected links, and each edge that such a step used, once."""
    frontier = cut(seeds.select("id").distinct())
    found, used = frontier.withColumn("hop", F.lit(0)), None
    for hop in range(1, depth + 1):
        # the edges at the frontier give both the next ids and the edges used, by one pass over them
        inside = near(frontier.withColumn("_in", F.lit(True)))
        at = lambda side: inside.select(F.col("id").alias(side), F.col("_in").alias(f"_{side}"))
        touched = cut(edges.join(at("source_id"), "source_id", "left").join(at("target_id"), "target_id", "left").where("_source_id or _target_id").select(edges.columns))
        ends = touched.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        frontier = cut(ends.join(found.select("id"), "id", "left_anti"))
        found = found.union(frontier.withColumn("hop", F.lit(hop)))
        used = touched if used is None else used.union(touched)
    used = edges.limit(0) if used is None else used.dropDuplicates(["id"]) if depth > 1 or "id" in edges.columns else used
    return nodes.join(found, "id"), used


def shortest_path(source: DataFrame, target: DataFrame, edges: DataFrame, cutoff: int = 6) -> DataFrame:
    """(step, id) of a shortest undirected path between two single-row frames of ids.

    Searches from both ends, always from the smaller frontier, until the frontiers share an id; so half the
    hops are made from each, and hubs are entered late. Of equal paths the one through the least meeting id
    and then over the least parents is given. No rows if the target is further than ``cutoff`` links away.
    """
    links = _narrow(_both(edges))
    start = lambda df: cut(df.select("id").limit(1).withColumn("parent", F.lit(None).cast("string")))
    sides = [[start(source)], [start(target)]]
    sizes = [1, 1]
    meeting = lambda: sides[0][-1].select("id").join(sides[1][-1].select("id"), "id", "left_semi").orderBy("id").limit(1)
    found = cut(meeting())
    while found.isEmpty():
        if len(sides[0]) + len(sides[1]) - 2 >= cutoff or 0 in sizes:
            return found.select(F.lit(0).alias("step"), "id").limit(0)
        side = sides[0] if sizes[0] <= sizes[1] else sides[1]
        seen = reduce(DataFrame.union, [x.select("id") for x in side])
        nxt = links.join(near(side[-1].select(F.col("id").alias("here"))), "here").groupBy(F.col("there").alias("id")).agg(F.min("here").alias("parent")).join(seen, "id", "left_anti")
        side.append(cut(nxt))
        sizes[0 if side is sides[0] else 1] = side[-1].count()
        found = cut(meeting())
    n = len(sides[0]) - 1
    rows = [found.select(F.lit(n).alias("step"), "id")]
    for side, sign in ((sides[0], -1), (sides[1], 1)):
        at = found.select("id")
        for k in range(len(side) - 1, 0, -1):
            at = side[k].join(at, "id", "left_semi").select(F.col("parent").alias("id"))
            rows.append(at.select(F.lit(n + sign * (len(side) - k)).alias("step"), "id"))
    return reduce(DataFrame.union, rows)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with the number of edges at it; a loop counts once. Ends are exploded, so no join is on an OR."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node"))
    counted = dealt(ends, "node", n=2 * edges.count()).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(counted, nodes["id"] == counted["node"], "left").drop("node").withColumn("degree", F.coalesce("degree", F.lit(0)))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def tests_for(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, kind: str = "tested_by") -> DataFrame:
    """Distinct targets of the seeds' edges of one type."""
    hit = edges.where(F.col("type") == kind).join(seeds.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    return nodes.join(hit, "id", "left_semi")


def communities(nodes: DataFrame, limit: int | None = 10) -> DataFrame:
    """Nodes counted by file, or by type where there is no file; the largest first."""
    counted = nodes.groupBy(F.coalesce("file_path", "type").alias("community")).agg(F.count("*").alias("size"))
    return counted.orderBy(F.desc("size"), "community").limit(limit) if limit else counted


def flow_rows(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Edges of some types with both names; edges with a missing end drop out."""
    named = nodes.select("id", "name")
    return (
        edges.where(F.col("type").isin(*types))
        .join(named.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
        .join(named.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id")
        .select("id", "source_name", "type", "target_name")
    )


def last_per_pair(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target), the last by id, as a simple directed graph holds."""
    pair = F.xxhash64("source_id", "target_id")
    pairs = dealt(edges.select(pair.alias("pair")), "pair", n=edges.count())
    several = near(cut(pairs.groupBy("pair").count().where("count > 1").select("pair", F.lit(True).alias("several"))))
    # most pairs have one edge, which stays where it is
    known = edges.withColumn("pair", pair).join(several, "pair", "left")
    last = known.where("several").groupBy("source_id", "target_id").agg(F.max(F.struct("id", "type")).alias("e"))
    return known.where("several is null").select("source_id", "target_id", "id", "type").union(last.select("source_id", "target_id", "e.id", "e.type"))
