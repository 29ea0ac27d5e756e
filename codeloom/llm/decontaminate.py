"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of test items.

Test items are indexed in entries of at most ``ENTRY`` words; a posting holds the share of
the entry's own BM25 score that the term gives, so one threshold suits all entries. Every
document is read in passages of two ``ENTRY`` lengths that overlap by half, so each entry's
copy lies whole inside some passage. A passage is a query for every entry that reaches
``THRESHOLD``:

1. entries stand in blocks, and each term has its largest share in each block; the terms of
   many passages are summed over these maxima at once, and blocks that can't reach the
   threshold are skipped (an entry's most frequent terms, at most ``REST`` of its score, are
   added to the bound without being looked up);
2. WAND with a pivot and block maxima scores what is left, exactly.

A hit is confirmed against the words around the passage: the item's question and its answer
must each occur there with an edit distance of at most a fifth of their words. The answer is
an item's last line, or the last fifth of a single line.

The items are collected only up to ``SHARD_CHARS`` characters at once; larger benchmarks are
worked through in shards, each against all documents and one after another: a shard's results are
cut from their lineage and its index is given up before the next is built, so no process holds two.

Defined cases: null and empty texts and items have no words and match nothing; items with
equal ids or texts each match on their own; rows are judged one by one, so repeated rows give
repeated results; long texts are read in blocks; an empty table gives an empty table; only
the named columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, small_batches

ENTRY = 64
THRESHOLD = 0.5
REST = 0.2
OVERLAP = 0.8
BLOCK = 2
POSTINGS_BLOCK = 16
K1, B = 1.2, 0.75
SHARD_CHARS = 32 << 20
#: Characters of a text whose words are held at once.
TEXT_BLOCK = 1 << 20

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    lines = [w for w in map(words_of, (text or "").split("\n")) if w]
    if len(lines) > 1:
        return [w for line in lines[:-1] for w in line], lines[-1]
    words = lines[0] if lines else []
    cut = len(words) - max(len(words) // 5, 1) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def least_distance(pattern: list, words: list) -> int:
    """Least edit distance between the pattern and any run of the words (bit-parallel, one column a word)."""
    if not pattern:
        return 0
    size = len(pattern)
    ones, top = (1 << size) - 1, 1 << (size - 1)
    rows: dict = {}
    for k, x in enumerate(pattern):
        rows[x] = rows.get(x, 0) | 1 << k
    up, down, now, best = ones, 0, size, size
    for x in words:
        same = rows.get(x, 0)
        diagonal = (((same & up) + up) ^ up | same | down) & ones
        right, left = (down | ~(diagonal | up)) & ones, diagonal & up
        now += bool(right & top) - bool(left & top)
        right, left = right << 1 & ones, left << 1 & ones
        up, down = (left | ~(diagonal | right)) & ones, right & diagonal
        best = min(best, now)
    return best


class Index:
    """Inverted index of a shard of test items."""

    def __init__(self, items: list[tuple]):
        self.items = []
        entries: list[tuple[int, Counter]] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            pieces = math.ceil(len(words) / ENTRY)
            for k in range(pieces):
                part = words[k * len(words) // pieces : (k + 1) * len(words) // pieces]
                entries.append((len(self.items), Counter(part)))
            self.items.append((item_id, *question_and_answer(text)))
        self.item_of = [i for i, _ in entries]
        frequency = Counter(t for _, terms in entries for t in terms)
        mean = sum(sum(c.values()) for _, c in entries) / max(len(entries), 1)
        self.term_ids = {t: k for k, t in enumerate(frequency)}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term_ids]
        bounds: list[dict[int, float]] = [{} for _ in self.term_ids]
        for e, (_, terms) in enumerate(entries):
            size = sum(terms.values())
            share = {t: math.log(1 + (len(entries) - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for t, n in terms.items()}
            whole = sum(share.values())
            left_out = 0.0
            for t in sorted(share, key=lambda t: (-frequency[t], t)):
                weight = share[t] / whole
                postings[self.term_ids[t]].append((e, weight))
                left_out += weight
                if left_out > REST:  # from here on terms count in the bound
                    at = bounds[self.term_ids[t]]
                    at[e // BLOCK] = max(at.get(e // BLOCK, 0.0), weight)
        self.n_blocks = -(-len(entries) // BLOCK) if entries else 0
        self.entries = [[e for e, _ in p] for p in postings]
        self.weights = [[w for _, w in p] for p in postings]
        self.most = [max(w) for w in self.weights]
        self.block_most = [[max(w[k : k + POSTINGS_BLOCK]) for k in range(0, len(w), POSTINGS_BLOCK)] for w in self.weights]
        self.bound_starts = np.cumsum([0, *map(len, bounds)])
        self.bound_blocks = np.array([b for at in bounds for b in at], np.int64)
        self.bound_weights = np.array([w for at in bounds for w in at.values()])
        self.margin = max((len(q) + len(a) for _, q, a in self.items), default=0) + ENTRY

    def likely(self, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(passage, blocks) that may reach the threshold, for the term ids of consecutive words (-1: no term)."""
        where = np.flatnonzero(ids >= 0)
        if not len(where):
            return
        slot = where // ENTRY
        n_terms = len(self.term_ids)
        pairs = np.unique(np.concatenate([slot * n_terms + ids[where], (slot - 1) * n_terms + ids[where]]))
        passage, term = np.divmod(pairs, n_terms)
        starts, counts = self.bound_starts[term], self.bound_starts[term + 1] - self.bound_starts[term]
        if not counts.sum():
            return
        at = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        key = (np.repeat(passage, counts) + 1) * self.n_blocks + self.bound_blocks[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.add.reduceat(self.bound_weights[at][order], first)
        ok = key[first][total >= THRESHOLD - REST - 1e-9]
        found: dict[int, list[int]] = {}
        for k in ok.tolist():
            found.setdefault(k // self.n_blocks - 1, []).append(k % self.n_blocks)
        yield from found.items()

    def search(self, terms: list[int], low: int, high: int) -> Iterator[tuple[int, float]]:
        """WAND: entries from low up to high whose share for the terms reaches the threshold."""
        lists = [[self.entries[t][k], t, k] for t in terms if (k := bisect_left(self.entries[t], low)) < len(self.entries[t])]
        floor = THRESHOLD - 1e-9
        while True:
            lists = sorted(x for x in lists if x[0] < high)
            bound, pivot = 0.0, None
            for n, (entry, t, _) in enumerate(lists):
                bound += self.most[t]
                if bound >= floor:
                    pivot = entry
                    break
            if pivot is None:
                return
            while n + 1 < len(lists) and lists[n + 1][0] == pivot:
                n += 1
            for x in lists[: n + 1]:
                if x[0] < pivot:
                    self._move(x, pivot)
            here = [x for x in lists if x[0] == pivot]
            if sum(self.block_most[t][k // POSTINGS_BLOCK] for _, t, k in here) >= floor:
                score = sum(self.weights[t][k] for _, t, k in here)
                if score >= floor:
                    yield pivot, score
            for x in here:
                self._move(x, pivot + 1)

    def _move(self, x: list, to: int) -> None:
        entries = self.entries[x[1]]
        x[2] = bisect_left(entries, to, x[2])
        x[0] = entries[x[2]] if x[2] < len(entries) else 1 << 60

    def hits(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Item place -> (score, question overlap, answer overlap) of the best confirmed passage."""
        found: dict[int, tuple[float, float, float]] = {}
        carried: list[str] = []
        for words in word_blocks(text or ""):
            words = carried + words
            ids = np.fromiter(map(self.term_ids.get, words, repeat(-1)), np.int64, len(words))
            for passage, blocks in self.likely(ids):
                start = passage * ENTRY
                terms = sorted({int(t) for t in ids[max(start, 0) : start + 2 * ENTRY] if t >= 0})
                for block in blocks:
                    for entry, score in self.search(terms, block * BLOCK, block * BLOCK + BLOCK):
                        place = self.item_of[entry]
                        if place in found and found[place][0] >= score:
                            continue
                        _, question, answer = self.items[place]
                        around = words[max(start - self.margin, 0) : start + 2 * ENTRY + self.margin]
                        asked = 1 - least_distance(question, around) / max(len(question), 1)
                        answered = 1 - least_distance(answer, around) / max(len(answer), 1)
                        if min(asked, answered) >= OVERLAP - 1e-9:
                            found[place] = (score, asked, answered)
            carried = words[-2 * (self.margin + 2 * ENTRY) :]
        return found


def word_blocks(text: str) -> Iterator[list[str]]:
    """A text's words, of about TEXT_BLOCK characters at a time; blocks end at white space where they can."""
    start = 0
    while start < len(text):
        end = start + TEXT_BLOCK
        if end < len(text):
            while end < len(text) and (text[end - 1].isalnum() or text[end - 1] == "_"):
                end += 1
        yield words_of(text[start:end])
        start = end


def _shards(items: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes of items of bounded size, one after another, and whether it is the only one."""
    chars, count = items.agg(F.sum(F.length("text")), F.count("*")).first()
    n = max(1, math.ceil(((chars or 0) + 64 * count) / SHARD_CHARS))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index([(r.item_id, r.text) for r in part.collect()]), n == 1


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every confirmed item in every document."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, item_id {tests.schema['item_id'].dataType.simpleString()}, score double, question_overlap double, answer_overlap double"
    out = None
    kinds = pa.schema([("doc_id", _arrow(picked, "doc_id")), ("item_id", _arrow(tests, "item_id")), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    for index, alone in _shards(tests):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = picked.mapInArrow(_worker(shared, kinds), schema)
        if not alone:  # the hits are kept and the shard is given up before the next one is built
            found = cut(found)
            shared.destroy()
        del index
        out = found if out is None else out.union(found)
    return out


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _worker(shared, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            rows = [(i.as_py(), index.items[place][0], *scores) for i, t in zip(b.column(0), b.column(1), strict=True) for place, scores in sorted(index.hits(t.as_py()).items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return work


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that hold no test item, with their own columns; each row is judged by its own text."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    for index, alone in _shards(items.select("item_id", "text")):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.hits(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
        if not alone:
            docs = cut(docs)
            shared.destroy()
        del index
    return docs
