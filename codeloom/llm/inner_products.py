"""Exact top-k by inner product: vectors in descending length, SVD-rotated partial sums, residual bounds.

All vectors are ordered by length over the whole table (range partitions), packed into blocks of
``BLOCK_ROWS``, and blocks are dealt to shards by hash, so every shard holds long and short ones and is
read from the longest down. Queries are packed into groups of ``GROUP_ROWS``. Every group meets every
shard once, in a cell of its own: queries are copied to shards and blocks to groups, a task streams the
blocks of a cell past its group, and so holds one group and one block. A rotation to the singular vectors of a
bounded sample (``SAMPLE`` vectors; any rotation gives the same results) puts most of the length first. A pair
goes on only while its partial sum plus the product of the two residual lengths (Cauchy-Schwarz) plus
a slack for rounding reaches the query's k-th score so far; what remains gets its exact integer
product. A query starts with its k-th score among the ``FIRST`` longest vectors, which keeps what cells return
small. The cells' best are merged by a window over each query.

Defined cases: vectors that are null or hold null, non-finite or too large components
(``vectors.LARGEST``) take no part, as query or candidate; only vectors of as many components are compared;
ties go to the smaller id, null ids last; repeated rows are candidates each, also of one another, and queries each; null
ids are never queries; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, small_batches
from codeloom.llm.vectors import BLOCK_ROWS, by_length, integer_vectors, matrix_of, packed_matrix, read_matrix

#: Queries in one group: a cell's working set is this by BLOCK_ROWS numbers.
GROUP_ROWS = 1024
#: Vectors the rotation is fitted on, those with the least hashes of their ids.
SAMPLE = 4096
#: The longest vectors, which give every query its first bound.
FIRST = 2048
#: Shares of the components after which residual bounds are tried.
STEPS = (1 / 8, 1 / 4, 1 / 2)
#: Pairs of a block that survive go to one dense product if they are over this share.
DENSE = 0.1
_NO_SCORE = np.iinfo(np.int64).min
_LAST_ID = np.iinfo(np.int64).max


def rotation_of(x: np.ndarray) -> np.ndarray:
    """Right singular vectors, those of the largest singular values first; an orthogonal square matrix."""
    return np.linalg.eigh(x.T.astype(np.float64) @ x.astype(np.float64))[1][:, ::-1]


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """All inner products. Those that doubles hold exactly go through one matrix product."""
    longest = lambda m: float(np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64)).max(initial=0.0)) ** 0.5
    if longest(x) * longest(q) < 2.0**52:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return x @ q.T


class Prepared:
    """Vectors with their lengths, rotated, and the residual lengths after each step."""

    def __init__(self, x: np.ndarray, turn: np.ndarray | None):
        self.x = x
        f = x.astype(np.float64)
        self.turned = f @ turn if turn is not None else f
        squares = self.turned**2
        self.length = np.sqrt((f * f).sum(axis=1))
        d = x.shape[1]
        self.cuts = sorted({w for s in STEPS if 0 < (w := round(d * s)) < d})
        self.rest = [np.sqrt(squares[:, w:].sum(axis=1)) for w in self.cuts]


class Best:
    """The k best candidates of each query of a group so far, as flat arrays in order of query and rank."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least, self.last_id = k, least.copy(), np.full(len(least), _LAST_ID)
        self.query, self.score, self.id, self.row = (np.empty(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        q, s = np.r_[self.query, query], np.r_[self.score, score]
        i, r = np.r_[self.id, ids], np.r_[self.row, rows]
        order = np.lexsort((r, i, -s, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        kept = order[place < self.k]
        self.query, self.score, self.id, self.row = q[kept], s[kept], i[kept], r[kept]
        full = order[place == self.k - 1]
        full = full[s[full] >= self.least[q[full]]]
        self.least[q[full]], self.last_id[q[full]] = s[full], i[full]

    def takes(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether candidates can still be among the best; of many copies only those with small ids can."""
        least = self.least[query]
        return (score > least) | ((score == least) & (ids <= self.last_id[query]))


def scan(block: Prepared, ids: np.ndarray, rows: np.ndarray, group: Prepared, group_rows: np.ndarray, best: Best) -> int:
    """Adds a block's candidates to the best of the group's queries; returns how many exact products it took."""
    least = best.least.astype(np.float64)
    slack = lambda a, b: 1e-9 * a[:, None] * b[None, :] + 1e-6
    bound = block.length[:, None] * group.length[None, :]
    some_q = np.flatnonzero(~(bound.max(axis=0) * (1 + 1e-9) + 1e-6 < least))
    if not len(some_q):
        return 0
    bound = bound[:, some_q]
    alive = ~(bound * (1 + 1e-9) + 1e-6 < least[some_q])
    partial, done = np.zeros_like(bound), 0
    for w, rest_x, rest_q in zip(block.cuts, block.rest, group.rest, strict=True):
        if alive.mean() <= DENSE / 4:
            break
        partial += block.turned[:, done:w] @ group.turned[some_q, done:w].T
        done = w
        alive &= ~(partial + rest_x[:, None] * rest_q[some_q][None, :] + slack(block.length, group.length[some_q]) < least[some_q])
    if alive.mean() > DENSE:
        computed = bound.size
        scores = exact_scores(block.x, group.x[some_q])
        c, q = np.nonzero(alive & (scores >= best.least[some_q]))
        score, q = scores[c, q], some_q[q]
    else:
        c, q = np.nonzero(alive)
        computed, q = len(c), some_q[q]
        score = np.einsum("ij,ij->i", block.x[c], group.x[q])
    good = (rows[c] != group_rows[q]) & best.takes(q, score, ids[c])
    best.add(q[good], score[good], ids[c[good]], rows[c[good]])
    return computed


def first_bounds(queries: np.ndarray, query_rows: np.ndarray, longest: np.ndarray, longest_rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the given vectors without itself; the least number if there are fewer."""
    if not len(longest):
        return np.full(len(queries), _NO_SCORE)
    scores = exact_scores(queries, longest)
    scores[query_rows[:, None] == longest_rows[None, :]] = _NO_SCORE
    return np.sort(scores, axis=1)[:, -k] if len(longest) >= k else np.full(len(queries), _NO_SCORE)


_CELL = "cell int, kind int, place double, components int, rows array<long>, ids array<long>, vectors binary, least array<long>"
_CELL_SCHEMA = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("place", pa.float64()), ("components", pa.int32()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("least", pa.list_(pa.int64()))])


def top_k(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the k best of all other vectors for each row where ``is_query``, a condition on ``id``."""
    spark = rows.sparkSession
    small_batches(spark)
    # numbered once and cut, so that a row keeps its number whatever is computed again
    numbered = cut(integer_vectors(rows, key, vector).withColumn("row", F.monotonically_increasing_id()))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    sized = numbered.withColumns({"length": F.sqrt(squares), "components": F.size("v")})
    common = [r.components for r in sized.groupBy("components").count().orderBy(F.desc("count"), "components").limit(4).collect()]
    longest, turns = {}, {}
    for d in common:  # bounded: FIRST and SAMPLE vectors; rarer kinds go without rotation and first bounds, with the same results
        some = sized.where(F.col("components") == d)
        far = some.orderBy(F.desc("length"), "row").limit(FIRST).select("row", "v").collect()
        longest[d] = (np.array([r.v for r in far], np.int64), np.array([r.row for r in far], np.int64))
        sample = some.orderBy(F.xxhash64("id"), "row").limit(SAMPLE).select("v").collect()
        turns[d] = rotation_of(np.array([r.v for r in sample], np.float64))

    def packed(kind: int, most: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = []

            def block(rows_, d):
                t = pa.Table.from_batches(rows_).combine_chunks().to_batches()[0]
                x, numbers = matrix_of(t.column(2), d), t.column(0).to_numpy()
                least = first_bounds(x, numbers, *longest.get(d, (np.empty((0, d), np.int64), np.empty(0, np.int64))), k) if kind == 0 else np.empty(0, np.int64)
                length = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max())
                return {"cell": 0, "kind": kind, "place": -length, "components": d, "rows": numbers.tolist(), "ids": t.column(1).to_pylist(), "vectors": packed_matrix(x), "least": least.tolist()}

            def full():
                d, parts = held[0][0], [p for _, p in held]
                held.clear()
                return pa.RecordBatch.from_pylist([block(parts, d)], _CELL_SCHEMA)

            for batch in batches:
                for d, part in by_length(batch, 2):
                    while part.num_rows:
                        if held and (held[0][0] != d or sum(p.num_rows for _, p in held) >= most):
                            yield full()
                        room = most - sum(p.num_rows for _, p in held)
                        held.append((d, part.slice(0, room)))
                        part = part.slice(room)
            if held:
                yield full()

        return pack

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order = sized.repartitionByRange(tasks, "components", F.desc("length"), "row").sortWithinPartitions("components", F.desc("length"), "row")
    blocks = cut(in_order.select("row", "id", "v").mapInArrow(packed(1, BLOCK_ROWS), _CELL).withColumn("number", F.monotonically_increasing_id()))
    asked = sized.where(F.coalesce(is_query, F.lit(False)))
    asked = asked.coalesce(max(1, min(tasks, -(-asked.count() // GROUP_ROWS)))).sortWithinPartitions("components", "row")
    groups = cut(asked.select("row", "id", "v").mapInArrow(packed(0, GROUP_ROWS), _CELL).withColumn("number", F.monotonically_increasing_id()))
    counts: dict[int, list[tuple[int, int, int]]] = {}
    part, first = F.shiftright("number", 33), F.min(F.col("number").bitwiseAND((1 << 33) - 1))
    for r in groups.groupBy("components", part.alias("part")).agg(F.count("*").alias("n"), first.alias("first")).orderBy("components", "part").collect():  # at most a row a task and kind
        counts.setdefault(r.components, []).append((r.part, r.first, r.n))
    found = None
    for d, parts in counts.items():
        mine, theirs = (f.where(F.col("components") == d) for f in (groups, blocks))
        n_groups, offset = sum(n for *_, n in parts), {}
        for p, least, n in parts:  # groups get the numbers 0, 1, ...
            offset[p] = sum(x for q, _, x in parts if q < p) - least
        shards = max(1, -(-4 * tasks // n_groups))  # enough cells for all tasks; each streams its blocks
        at = F.element_at(F.create_map(*[F.lit(x) for kv in offset.items() for x in kv]), part) + F.col("number").bitwiseAND((1 << 33) - 1)
        queries = mine.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("cell", (at * shards + F.col("shard")).cast("int")).drop("shard")
        shard = F.pmod(F.xxhash64("number"), F.lit(shards))
        candidates = theirs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).withColumn("cell", (F.col("group") * shards + shard).cast("int")).drop("group")
        cells = queries.unionByName(candidates).drop("number").repartition(max(1, min(n_groups * shards, 4 * tasks)), "cell").sortWithinPartitions("cell", "kind", "place")
        best = cells.mapInArrow(_searched(turns.get(d), k), "query_row long, query_id long, row long, vec_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return numbered.where("false").select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"), F.col("row").alias("query_row"))
    by_rank = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_row")


def _searched(turn: np.ndarray | None, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = group = best = None

        def result() -> pa.RecordBatch:
            numbers, ids = group[1], group[2]
            q = best.query
            unknown = best.id == _LAST_ID
            columns = [numbers[q], ids[q], best.row, pa.array(best.id, pa.int64(), mask=unknown), best.score]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_row", "query_id", "row", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                x = Prepared(read_matrix(row["vectors"], row["components"]), turn)
                numbers = np.array(row["rows"], np.int64)
                ids = np.array([_LAST_ID if i is None else i for i in row["ids"]], np.int64)
                if row["cell"] != cell:
                    if group is not None:
                        yield result()
                    cell, group, best = row["cell"], None, None
                if row["kind"] == 0:
                    group, best = (x, numbers, ids), Best(np.array(row["least"], np.int64), k)
                elif group is not None:
                    scan(x, ids, numbers, group[0], group[1], best)
        if group is not None:
            yield result()

    return work
