"""Centroid clustering by Elkan's bounds, exact in integers.

Vectors are packed into blocks of ``BLOCK_ROWS`` once. Beside each block stands what is cached of its
vectors: the assigned centroid, an upper bound of the distance to it, and a lower bound of the
distance to each centroid. A round sends the centroids (k rows, bounded by the parameter) to the
blocks. There, bounds move by how far the centroids moved, and a distance is computed only if
neither the lower bound nor half the distance between two centroids shows that the other centroid is
farther. Distances are sums of squares in 64-bit integers; only bounds are floating-point, rounded
away from the distance (``_up``, ``_down``), and pruning takes strictly larger bounds, so ties are always
computed and go to the smaller number. Each block also gives its sums by centroid, so a round
shuffles k * components numbers a block, summed before the shuffle, and no vector ever moves.
The state is cut from its lineage each round in the shared checkpoint folder.

Defined cases: vectors of another number of components, null vectors, and those with null,
non-finite or too large components (``vectors.LARGEST``) aren't clustered and not returned; repeated
rows count each; a null id counts, but starts no centroid before the others; with fewer vectors than
k there are as many centroids; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, small_batches
from codeloom.llm.vectors import by_length, integer_vectors, matrix_of, packed_matrix, read_matrix

COMPONENTS = 64
CENTROIDS = 8
ROUNDS = 10
SEED = "3:"
_BLOCK = "ids array<long>, vectors binary, own binary, upper binary, lower binary, computed binary, sums array<long>"


def _up(squares: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded up: conversion and root are off by half a unit each."""
    root = np.sqrt(squares.astype(np.float64))
    return np.where(squares == 0, 0.0, np.nextafter(np.nextafter(root, np.inf), np.inf))


def _down(squares: np.ndarray) -> np.ndarray:
    root = np.sqrt(squares.astype(np.float64))
    return np.maximum(0.0, np.nextafter(np.nextafter(root, 0.0), 0.0))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids of a round, how far each moved, and half the distances between them, rounded down."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.at = now
        self.moved = _up(_squares(now, before)) if before is not None else np.zeros(len(now))
        self.half = np.nextafter(np.array([_down(_squares(now, c)) for c in now]) / 2, 0.0)
        others = self.half + np.where(np.eye(len(now), dtype=bool), np.inf, 0.0)
        self.nearest = others.min(axis=1)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, computed: np.ndarray, centroids: Centroids) -> None:
    """One round over the rows of ``x``; changes their cached state in place."""
    moved = centroids.moved[own]
    upper[:] = np.where(moved > 0, np.nextafter(upper + moved, np.inf), upper)
    lower[:] = np.where(centroids.moved > 0, np.maximum(0.0, np.nextafter(lower - centroids.moved, -np.inf)), lower)
    open_ = np.flatnonzero(~(centroids.nearest[own] > upper))
    if not len(open_):
        return
    best = _squares(x[open_], centroids.at[own[open_]])
    upper[open_], lower[open_, own[open_]] = _up(best), _down(best)
    computed[open_] += 1
    for c in range(len(centroids.at)):
        mine = own[open_]
        k = np.flatnonzero((mine != c) & ~(lower[open_, c] > upper[open_]) & ~(centroids.half[mine, c] > upper[open_]))
        if not len(k):
            continue
        rows = open_[k]
        d = _squares(x[rows], centroids.at[c])
        lower[rows, c] = _down(d)
        computed[rows] += 1
        nearer = (d < best[k]) | ((d == best[k]) & (c < own[rows]))
        own[rows[nearer]], best[k[nearer]], upper[rows[nearer]] = c, d[nearer], _up(d[nearer])


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Number of vectors and sum of each component, by centroid."""
    return np.concatenate([np.r_[np.count_nonzero(own == c), x[own == c].sum(axis=0)] for c in range(k)])


def _blocks(vectors: DataFrame, components: int, k: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in by_length(batch, 1):
                n = rows.num_rows
                state = (np.zeros(n, "<i4"), np.full(n, np.inf, "<f8"), np.zeros((n, k), "<f8"), np.zeros(n, "<i4"))
                x = matrix_of(rows.column(1), components)
                yield pa.RecordBatch.from_pylist([{"ids": rows.column(0).to_pylist(), "vectors": packed_matrix(x), **dict(zip(("own", "upper", "lower", "computed"), (s.tobytes() for s in state), strict=True)), "sums": []}], _SCHEMA)

    return vectors.mapInArrow(pack, _BLOCK)


_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("vectors", "own", "upper", "lower", "computed")), ("sums", pa.list_(pa.int64()))])


def _read(row: dict, components: int, k: int) -> tuple[np.ndarray, ...]:
    part = lambda c, kind: np.frombuffer(row[c], kind).copy()
    return read_matrix(row["vectors"], components), part("own", "<i4"), part("upper", "<f8"), part("lower", "<f8").reshape(-1, k), part("computed", "<i4")


def _round(blocks: DataFrame, centroids: Centroids, components: int) -> DataFrame:
    k = len(centroids.at)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x, own, upper, lower, computed = _read(row, components, k)
                assign(x, own, upper, lower, computed, centroids)
                out.append(row | {"own": own.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "computed": computed.tobytes(), "sums": _sums(x, own, k).tolist()})
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return blocks.mapInArrow(work, _BLOCK)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the least SHA-256 of seed and id, in order of it."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    found = vectors.orderBy(F.asc_nulls_last(digest), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def clusters(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, computed) of every clustered vector, the final centroids).

    ``distance`` is squared; ``computed`` counts the distances that the bounds didn't save, of k * (rounds + 1).
    """
    small_batches(rows.sparkSession)
    vectors = integer_vectors(rows, key, vector, components)
    at = first_centroids(vectors, k, seed)
    k = len(at)
    if not k:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("computed")), at
    blocks, before = _blocks(vectors, components, k), None
    for _ in range(rounds):
        blocks = cut(_round(blocks, Centroids(at, before), components))
        total = np.zeros(k * (components + 1), np.int64)
        for r in blocks.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # k * (components + 1) rows
            total[r["at"]] = r["n"]
        total = total.reshape(k, components + 1)
        filled = total[:, :1] > 0
        before, at = at, np.where(filled, total[:, 1:] // np.maximum(total[:, :1], 1), at)
    last = Centroids(at, before)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, own, upper, lower, computed = _read(row, components, k)
                assign(x, own, upper, lower, computed, last)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(own, pa.int32()), pa.array(_squares(x, at[own]), pa.int64()), pa.array(computed, pa.int32())], ["id", "cluster", "distance", "computed"])

    return cut(blocks.mapInArrow(rows_of, "id long, cluster int, distance long, computed int")), at


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the inertia of each cluster and of all, null where a long can't hold it, and the digest of each final centroid."""
    from hashlib import sha256

    sums = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}  # a row a centroid
    long_or_null = lambda n: F.lit(int(n) if n < 1 << 63 else None).cast("long")

    def by_cluster(value, kind: str):
        out = F.lit(None).cast(kind)
        for c in range(len(centroids)):
            out = F.when(F.col("cluster") == c, value(c)).otherwise(out)
        return out

    digests = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return found.withColumns({"cluster_inertia": by_cluster(lambda c: long_or_null(sums.get(c, 0)), "long"), "inertia": long_or_null(sum(sums.values())), "centroid_sha256": by_cluster(lambda c: F.lit(digests[c]), "string")})
