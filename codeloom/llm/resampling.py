"""Draws documents whose hashed word features resemble a target's.

Identical texts are collapsed first, by grouping the full text with a count before the shuffle, so a
group of copies costs one text. Features of a text, all runs of one and two words, are computed once for it
and stored as bucket numbers. Bucket counts of the corpus add each text's features times its copies; those of
the target likewise. A bucket's gain is the logarithm of the smoothed ratio of both, and a text's weight the
floored mean of its features' gains. Weights go back to the documents by the texts' digests (SHA-256), a join of
narrow rows with unique keys on one side, so the documents of a hot text are split by the adaptive skew join.
Only then each document gets its own noise. Ranks need no global sort: how many documents stand above each score is counted (scores are whole numbers in a
range that the bucket counts bound, so there are at most some ten thousands), and only rows above the
last drawn score are numbered, within their score.

Defined cases: null and empty texts, and texts without a word, have no features and weight 0;
null ids read as an empty id and rank last among equal scores; repeated rows are documents each, those with the
same id and score by features and weight; with an empty target all gains come from smoothing; an empty table gives an empty
result; further columns are not read. Long texts are split in blocks of ``TEXT_BLOCK`` bytes that end with a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, small_batches

BUCKETS = 10_000
SEED = "7:"
LEAST_WORDS = 20
PERCENT = 25
TEXT_BLOCK = 1 << 20
#: Bytes of words stand for themselves, capitals for their small letters, all others for a space.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    start = 0
    while start < len(text):
        piece = text[start : start + TEXT_BLOCK].translate(_WORD_BYTES)
        start += len(piece)
        while start < len(text) and piece[-1] != 0x20:  # to the end of the last word
            more = text[start : start + 64].translate(_WORD_BYTES)
            end = more.find(b" ") + 1 or len(more)
            piece, start = piece + more[:end], start + end
        yield piece.split()


def buckets_of(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of all its features."""
    n, parts, last = 0, [], b""
    for words in _words(text):
        if not words:
            continue
        ones = list(map(crc32, words))
        spaced = list(map(crc32, repeat(b" "), ones))  # of each word and a space
        twos = list(map(crc32, words[1:], spaced))
        if n:
            twos.append(crc32(words[0], crc32(b" ", crc32(last))))
        parts += [np.array(ones, np.int64), np.array(twos, np.int64)]
        n, last = n + len(words), words[-1]
    found = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return n, (found % buckets).astype(_kind(buckets))


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def collapsed(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(digest, copies, n_words, buckets) of each distinct text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [buckets_of(t.as_py(), buckets) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["digest", "copies", "n_words", "buckets"])

    return texts.select(_digest("text"), "copies", "text").mapInArrow(work, "digest binary, copies long, n_words long, buckets binary")


def _digest(text: str):
    return F.unhex(F.sha2(F.col(text), 256)).alias("digest")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents fall into each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for copies, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total += np.bincount(np.frombuffer(data.as_py(), _kind(buckets)), minlength=buckets) * copies
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("copies", "buckets").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (all_s + n)) / float((s + 1) * (all_t + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, copies, n_words, n_features, weight) of each distinct text."""
    kind = _kind(len(gain))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x.as_py(), kind) for x in b.column(3)]
            weight = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(x) for x in found], pa.int64()), pa.array(weight, pa.int64())], ["digest", "copies", "n_words", "n_features", "weight"])

    return texts.mapInArrow(work, "digest binary, copies long, n_words long, n_features long, weight long")


def _noise(seed: str):
    """Gumbel noise of a document, in thousandths, from the hash of its id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it wasn't drawn."""
    texts = cut(collapsed(docs, text, buckets))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(collapsed(target, target_text, buckets), buckets))
    facts = weighted(texts, gain).drop("copies")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", _digest("text"))
    scored = cut(rows.join(facts, "digest").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + _noise(seed)).alias("score")))
    may = F.col("n_words") >= least_words
    by_score = scored.where(may).groupBy("score").agg(F.count("*").alias("n"))
    quota = (by_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    # a row for each score, which the range of gains and noise bounds
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = by_score.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above")).where(F.col("above") < quota)
    placed = scored.join(F.broadcast(places), "score", "left")
    among = may & F.col("above").isNotNull()
    in_score = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    numbered = placed.where(among).withColumn("rank", F.col("above") + F.row_number().over(in_score))
    kept = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    drawn = numbered.select(*kept, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    return drawn.unionByName(placed.where(~among).select(*kept, F.lit(None).cast("long").alias("rank")))
