"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Features are words and their starts of ``STARTS`` letters. A bounded sample of labelled
rows (``EXAMPLES``, those with the least hashes of their ids) gives the examples. Features of
at least ``LEAST_DOCS`` examples that tell their classes apart (a two-proportion z of at least
``LEAST_Z``) span the space, and z weighs their TF-IDF. How many documents hold a feature is
counted over all documents. Examples stand in blocks of an inverted index: postings by
feature, and for the long lists the largest weight of each feature in each block. A document sums
its short lists, adds the block maxima of its long ones, and sums long lists only in blocks
that can reach its ``NEIGHBOURS``-th example, which keeps the search exact. Similarities
weigh the votes, and ``PRIOR`` votes go to the rate among examples. Neighbours are returned
as evidence.

Defined cases: null and empty texts, and texts without any feature, get the rate among the
examples without features; ties of similarity go to the least example id; rows are judged
one by one, so repeated rows and null ids need nothing; null labels, and labels of ids that
are no whole numbers, don't count; without
labelled rows every score is 0; an empty table gives an empty table; only the named columns
are read, and neither id nor language or source are features. Long texts are read in blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, small_batches

EXAMPLES = 8000
#: Characters of the examples together; with EXAMPLES it bounds the index, which is broadcast.
SAMPLE_CHARS = 64 << 20
FOLDS = 3
#: The model's size, a bound on what is broadcast: at most so many features, those with the largest z.
FEATURES = 1 << 16
LEAST_Z = 2.0
LEAST_DOCS = 2
STARTS = (4, 5, 6, 7, 8)
NEIGHBOURS = 25
PRIOR = 1.0
BLOCK = 64
#: Features in more than one of so many examples have long lists, at most so many; this decides on speed only.
LONG_SHARE, LONG_LISTS = 40, 1024
#: Examples that are summed first, those with the best bounds.
FIRST = 64
KNOWN_WORDS = 500_000
#: Texts whose results a task remembers, for copies.
REMEMBERED_TEXTS = 512
TEXT_BLOCK = 1 << 20
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def word_counts(text: str | None) -> Counter:
    """How often each lower-case word stands in the whole text."""
    text = text or ""
    if len(text) <= TEXT_BLOCK:
        return Counter(_WORD.findall(text.lower()))
    out: Counter = Counter()
    start = 0
    while start < len(text):
        end = start + TEXT_BLOCK
        while end < len(text) and (text[end - 1].isalnum() or text[end - 1] == "_"):
            end += 1
        out.update(_WORD.findall(text[start:end].lower()))
        start = end
    return out


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in STARTS if len(word) >= n)]


class _Numbers(dict):
    """Numbers of words; a new word gets the next number and the places of its features."""

    def __init__(self, place: dict[str, int]):
        super().__init__()
        self.place, self.flat, self.ends = place, [], []
        self.heads = {f[: STARTS[0]] for f in place if f[0] != "="}  # most new words start like no feature

    def __missing__(self, word: str) -> int:
        whole = self.place.get(f"={word}")
        if whole is not None:
            self.flat.append(whole)
        if word[: STARTS[0]] in self.heads:
            self.flat += [self.place[f] for f in features_of(word)[1:] if f in self.place]
        self.ends.append(len(self.flat))
        self[word] = n = len(self)
        return n


class Space:
    """Turns texts into counts of known features."""

    def __init__(self, features: list[str]):
        self.place = {f: k for k, f in enumerate(features)}
        self._start()

    def _start(self) -> None:
        self.numbers = _Numbers(self.place)
        self.flat, self.ends, self.known = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0

    def __getstate__(self):
        return {"place": self.place}  # what was remembered stays behind

    def __setstate__(self, state):
        self.place = state["place"]
        self._start()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts) of the features that a text has."""
        if len(self.numbers) >= KNOWN_WORDS:
            self._start()
        words = word_counts(text)
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        n = np.fromiter(words.values(), np.int64, len(words))
        new = self.numbers.ends
        if new:  # what this text brought; arrays double when they are full
            first = int(self.ends[self.known])
            self.flat = _put(self.flat, first, self.numbers.flat)
            self.ends = _put(self.ends, self.known + 1, [first + e for e in new])
            self.known += len(new)
            self.numbers.flat, self.numbers.ends = [], []
        at, by = _ranges(self.ends[numbers], self.ends[numbers + 1], n)
        places, where = np.unique(self.flat[at], return_inverse=True)
        return places, np.bincount(where, by, len(places)).astype(np.int64)


def _put(held: np.ndarray, at: int, values: list[int]) -> np.ndarray:
    """``held`` with values from a place on, in an array of twice the length if they don't fit."""
    while at + len(values) >= len(held):
        held = np.r_[held, np.zeros(len(held), held.dtype)]
    held[at : at + len(values)] = values
    return held


def _ranges(starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after another, each with the value of its range."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum()), np.repeat(values, sizes)


class Index:
    """Postings of the examples by feature and block, with the largest weight of each feature in each block."""

    def __init__(self, features: list[str], scale: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.space, self.scale = Space(features), scale
        rows = []
        empty = [0, 0]
        for i, label, places, counts in sorted(examples, key=lambda e: e[0]):
            v = self.vector(places, counts)
            if v is None:
                empty[0] += label
                empty[1] += 1
            else:
                rows.append((i, label, *v))
        # examples with the same strongest feature stand together, so that block bounds are tight
        rows.sort(key=lambda r: (int(r[2][np.argmax(r[3])]), -float(r[3].max()), r[0]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.float64)
        self.block = BLOCK
        self.blocks = -(-len(rows) // BLOCK)
        feature = np.concatenate([np.empty(0, np.int64), *(r[2] for r in rows)])
        row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        weight = np.concatenate([np.empty(0, np.float32), *(r[3] for r in rows)])
        lengths = np.bincount(feature, minlength=len(features))
        # long lists stand as rows over all examples, with their maxima by block; the others as postings
        common = np.argsort(-lengths, kind="stable")[: min(LONG_LISTS, int((lengths > len(rows) / LONG_SHARE).sum()))]
        self.long_at = np.full(len(features), -1, np.int32)
        self.long_at[common] = np.arange(len(common))
        is_long = self.long_at[feature] >= 0 if len(feature) else np.zeros(0, bool)
        self.long = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        self.long[self.long_at[feature[is_long]], row[is_long]] = weight[is_long]
        self.long_most = self.long.reshape(len(common), self.blocks, BLOCK).max(axis=2) if self.blocks else np.zeros((len(common), 0), np.float32)
        feature, row, weight = feature[~is_long], row[~is_long], weight[~is_long]
        order = np.lexsort((row, feature))
        self.row, self.weight = row[order].astype(np.int32), weight[order]
        self.list_at = np.searchsorted(feature[order], np.arange(len(features) + 1))
        n = len(examples)
        self.rate = sum(e[1] for e in examples) / n if n else 0.0
        self.empty_rate = (empty[0] + PRIOR * self.rate) / (empty[1] + PRIOR)
        self.calibration = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("by_example", "room")}

    def __getattr__(self, name: str):
        if name == "by_example":  # made where it is used
            self.by_example = np.ascontiguousarray(self.long.T)
            return self.by_example
        if name == "room":
            self.room = np.empty_like(self.long)
            return self.room
        raise AttributeError(name)

    def calibrated(self, share: float) -> float:
        return round(float(np.interp(share, *self.calibration)), 9)

    def vector(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        used = self.scale[places] > 0
        places = places[used]
        if not len(places):
            return None
        values = (1 + np.log(counts[used])) * self.scale[places]
        norm = math.sqrt(float(values @ values))
        return (places, (values / norm).astype(np.float32)) if norm else None

    def nearest(self, places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and rows of the NEIGHBOURS best examples with any feature in common.

        Short lists are summed in full. What the long lists can add to a block's examples is at most their maxima
        in it; the examples with the best bounds give a threshold, and only blocks that can reach it are summed.
        """
        short = self.long_at[places] < 0
        at = places[short]
        postings, by = _ranges(self.list_at[at], self.list_at[at + 1], values[short].astype(np.float64))
        s = np.bincount(self.row[postings], by * self.weight[postings], self.blocks * self.block)
        lists, q = self.long_at[places[~short]], values[~short].astype(np.float32)
        bound = s.reshape(self.blocks, self.block) + (q @ self.long_most[lists])[:, None]
        rough = np.full((self.blocks, self.block), -1.0)  # sums in single precision, good to 1e-5
        first = np.argpartition(bound, -min(FIRST, bound.size), axis=None)[-min(FIRST, bound.size) :]
        rough.reshape(-1)[first] = sums = s[first] + self.by_example[first][:, lists] @ q
        kth = lambda x: np.partition(x, -NEIGHBOURS, axis=None)[-NEIGHBOURS] - 2e-5 if x.size >= NEIGHBOURS else -1.0
        rest = np.flatnonzero(bound.max(axis=1) >= kth(sums))
        if len(rest) * 3 > self.blocks:  # one pass over the lists costs less than many blocks
            rough[:] = s.reshape(self.blocks, self.block) + (q @ np.take(self.long, lists, axis=0, out=self.room[: len(lists)], mode="clip")).reshape(self.blocks, self.block)
        else:
            table = self.long.reshape(len(self.long), self.blocks, self.block)
            rough[rest] = s.reshape(self.blocks, self.block)[rest] + np.einsum("f,fbe->be", q, table[lists[:, None], rest[None, :]])
        rows = np.flatnonzero((rough.reshape(-1) > 0) & (rough.reshape(-1) >= kth(rough)))
        rows = rows[rows < len(self.ids)]
        exact = s[rows] + self.by_example[rows][:, lists].astype(np.float64) @ values[~short].astype(np.float64)
        kept = np.lexsort((self.ids[rows], -np.round(exact, 6)))[:NEIGHBOURS]
        return exact[kept], rows[kept]

    def share(self, places: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Share of the votes for label 1, and the nearest examples."""
        v = self.vector(places, counts)
        if v is None or not len(self.ids):
            return self.empty_rate, []
        s, rows = self.nearest(*v)
        votes = s**2
        score = (float(votes @ self.labels[rows]) + PRIOR * self.rate) / (float(votes.sum()) + PRIOR)
        return round(score, 9), self.ids[rows[:3]].tolist()


def monotone_map(shares: np.ndarray, labels: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of a map from shares of votes to rates of label 1 that never falls.

    Neighbours in order are pooled while their rates fall (isotonic regression); a pool's rate has ``PRIOR`` votes of
    ``rate`` added and stands at the pool's mean share. Between the points, and to 0 and 1 at the ends, the map is linear.
    """
    order = np.lexsort((-labels, shares))  # equal shares end in one pool
    pools: list[list[float]] = []  # number, sum of shares, sum of labels
    for x, y in zip(shares[order].tolist(), labels[order].tolist(), strict=True):
        pools.append([1.0, x, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x = np.array([p[1] / p[0] for p in pools])
    y = np.maximum.accumulate(np.array([(p[2] + PRIOR * rate) / (p[0] + PRIOR) for p in pools]))
    return np.r_[0.0, x, 1.0], np.r_[0.0, y, 1.0]


def featured(docs: DataFrame, features: list[str], text: str = "text") -> DataFrame:
    """Every row with the places and counts of its known features in place of its text, cut from its lineage: texts are split once."""
    rest = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(features)
        counts = lru_cache(REMEMBERED_TEXTS)(space.counts)  # copies that follow one another
        for b in batches:
            found = [counts(t.as_py()) for t in b.column(len(rest))]
            packed = [pa.array([x[k].astype("<u4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *packed], [*rest, "places", "counts"])

    return cut(docs.select(*rest, text).mapInArrow(work, f"{kinds}{', ' if rest else ''}places binary, counts binary"))


def _numbers(data) -> np.ndarray:
    return np.frombuffer(data.as_py(), "<u4").astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES, folds: int = FOLDS) -> tuple[Index, DataFrame]:
    """(an index of labelled rows of ``labels`` (doc_id, label), all documents as ``featured`` for it).

    Document counts are those of all of ``docs``; without ``folds`` the index isn't calibrated.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).try_cast("long").alias("id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).try_cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(examples)
    sample = F.broadcast(chosen)  # at most ``examples`` rows of two numbers
    found = texts.join(sample, "id").groupBy("id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(max(folds, 1))).cast("int")
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("id"), "id"))  # over at most ``examples`` rows
    rows = cut(found.withColumns({"fold": fold, "so_far": so_far}).where(F.col("so_far") <= SAMPLE_CHARS).drop("so_far").repartition(docs.sparkSession.sparkContext.defaultParallelism, "id"))
    sizes = np.zeros((max(folds, 1), 2), np.int64)
    for r in rows.groupBy("fold", "label").count().collect():  # a row a fold and label
        sizes[r.fold, r.label] = r["count"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, int], list[int]] = {}
            for j, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for f in {f for w in word_counts(t) for f in features_of(w)}:
                    found.setdefault((f, j), [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([j for _, j in found], pa.int32()), *(pa.array([v[y] for v in found.values()], pa.int64()) for y in (0, 1))], ["f", "fold", "n0", "n1"])

    of_fold = lambda n, j: F.sum(F.when(F.col("fold") == j, F.col(n)).otherwise(0)).alias(f"{n}_{j}")
    counted = cut(rows.select("fold", "label", "text").mapInArrow(spread, "f string, fold int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *[of_fold(n, j) for j in range(folds) for n in ("n0", "n1")]))

    def telling(without: int | None) -> dict[str, float]:
        """The features that tell the labels apart, with z; ``without`` a fold's examples."""
        n0, n1 = (int(n) for n in sizes.sum(axis=0) - (sizes[without] if without is not None else 0))
        if not n0 or not n1:
            return {}
        a, b = (F.col(n) - (F.col(f"{n}_{without}") if without is not None else 0) for n in ("n0", "n1"))
        p = (a + b) / (n0 + n1)
        z = F.abs((b / n1 - a / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + F.lit(1e-12)))
        best = counted.where(a + b >= LEAST_DOCS).select("f", z.alias("z")).where(f"z >= {LEAST_Z}").orderBy(F.desc("z"), "f").limit(FEATURES)
        return {r.f: r.z for r in best.collect()}  # at most FEATURES

    weights = [telling(j) for j in (None, *range(folds))]
    features = sorted(set().union(*weights))

    every = featured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), features)

    def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(features), np.int64), 0
        for b in batches:
            n += b.num_rows
            total += np.bincount(np.concatenate([np.empty(0, np.int64), *map(_numbers, b.column(0))]), minlength=len(features))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, there], pa.int64()), pa.array(np.r_[n, total[there]], pa.int64())], ["k", "n"])

    idf = np.zeros(len(features))
    if features:
        held = {r.k: r.n for r in every.select("places").mapInArrow(held_by, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
        idf = np.array([math.log((1 + held[-1]) / (1 + held[k])) + 1 for k in range(len(features))])
    scales = [idf * np.array([w.get(f, 0.0) for f in features]) for w in weights]

    few = featured(rows.select("id", "label", "fold", "text"), features)
    read = lambda data: np.frombuffer(data, "<u4").astype(np.int64)
    kept = [(r.id, r.label, r.fold, read(r.places), read(r.counts)) for r in few.collect()]  # of SAMPLE_CHARS characters at most
    shares, truth = [], []
    for j in range(folds):  # one fold's index at a time
        others = few.sparkSession.sparkContext.broadcast(Index(features, scales[j + 1], [(i, y, p, c) for i, y, k, p, c in kept if k != j]))

        def judged(batches: Iterator[pa.RecordBatch], others=others) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [others.value.share(_numbers(p), _numbers(c))[0] for p, c in zip(b.column(1), b.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["label", "share"])

        for r in few.where(F.col("fold") == j).select("label", "places", "counts").mapInArrow(judged, "label int, share double").collect():
            shares.append(r.share)
            truth.append(r.label)
        others.destroy()
    index = Index(features, scales[0], [(i, y, p, c) for i, y, _, p, c in kept])
    if len(set(truth)) == 2:
        index.calibration = monotone_map(np.array(shares), np.array(truth, np.float64), index.rate)
    return index, every


def score(every: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, share, neighbours) of every document of ``train`` or ``featured``; ``share`` is the score before calibration."""
    shared = every.sparkSession.sparkContext.broadcast(index)  # of texts of SAMPLE_CHARS characters at most, and LONG_LISTS rows over EXAMPLES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        judged = lru_cache(REMEMBERED_TEXTS)(lambda p, c: at.share(np.frombuffer(p, "<u4").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)))
        for b in batches:
            found = [judged(p.as_py(), c.as_py()) for p, c in zip(b.column(1), b.column(2), strict=True)]
            share = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([at.calibrated(s) for s in share], pa.float64()), pa.array(share, pa.float64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "score", "share", "neighbours"])

    return every.select("doc_id", "places", "counts").mapInArrow(work, f"doc_id {every.schema['doc_id'].dataType.simpleString()}, score double, share double, neighbours array<long>")
