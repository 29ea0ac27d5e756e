"""Byte-level BPE over contiguous rank arrays.

A piece of text (a short word) is an array of parts and an array with the rank of every
adjacent pair. Again and again the lowest rank is looked for, the boundary behind it goes,
and the two ranks beside it are looked up anew. All new pieces of a slice of text are
merged side by side in numpy arrays, one row a piece; a piece of more than ``LONG`` bytes
is merged with a heap instead, as scanning it would take quadratic time.

The vocabulary file is a parameter and is read once by each Python worker. Ids of known
pieces are kept in a bounded table. Texts are worked through slice by slice, so a very
long one needs no more memory than its slice.

Defined cases: a null text encodes as an empty one (no ids); texts of any length, repeated
rows and null ids need nothing, as rows are encoded one by one; an empty table gives an
empty table; only the named columns of the input are read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import small_batches

LONG = 64
WIDTHS = (8, 12, 16, 24, 32, LONG)
#: Pieces whose ids a worker keeps.
KEPT_PIECES = 400_000
#: Pieces worked on at once.
SLICE = 200_000
#: Fixed by the vocabulary's format: contractions, then runs of letters, digits and other
#: characters with at most one space before them, then white space.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
#: Finds pieces in texts of Latin letters and printable ASCII, where the standard library's
#: classes and the pattern above agree.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ʯ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ʯ]+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ʯ]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte: itself if visible, else the next free one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.id_of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.id_of_byte[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.piece = regex.compile(PIECE)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of each row of byte ids; -1 fills up short rows."""
        rows, width = parts.shape
        done: list[bytes] = [b""] * rows
        where = np.arange(rows)
        ranks = np.full((rows, width), NONE, np.int32)
        ranks[:, : width - 1] = self.rank(parts[:, :-1], parts[:, 1:])
        places = np.arange(width)[None, :]
        while len(where):
            low = ranks.argmin(axis=1)
            best = ranks[np.arange(len(low)), low]
            go = best != NONE
            if not go.all():
                over = parts[~go]
                used = over >= 0
                ends = np.cumsum(used.sum(axis=1) * 4).tolist()
                flat = over[used].astype("<u4").tobytes()
                for k, start, end in zip(where[~go].tolist(), [0, *ends], ends, strict=False):
                    done[k] = flat[start:end]
                parts, ranks, where, low, best = parts[go], ranks[go], where[go], low[go], best[go]
            if not len(low):
                break
            each = np.arange(len(low))
            parts[each, low] = self.merged[best]
            behind = places > low[:, None]
            parts[:, :-1] = np.where(behind[:, :-1], parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            for at in (low - 1, low):  # the ranks on both sides of the new part
                there = (at >= 0) & (at < width - 1)
                row, col = each[there], at[there]
                ranks[row, col] = self.rank(parts[row, col], parts[row, col + 1])
        return done

    def merge_long(self, word: bytes) -> bytes:
        """The same for one long piece: a heap of pairs over a linked list of parts."""
        ids = self.id_of_byte[np.frombuffer(word, np.uint8)]
        ranks = self.rank(ids[:-1], ids[1:])
        parts = ids.tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), k, parts[k], parts[k + 1]) for k, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k] if parts[k] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[k], parts[j] = int(self.merged[rank]), -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n:
                    r = int(self.rank(np.array([parts[x]]), np.array([parts[y]]))[0])
                    if r != NONE:
                        heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Merges the pieces that aren't known yet."""
        new = {p: p.encode("utf-8", "replace") for p in pieces if p not in self.known}
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known = {}
            new = {p: p.encode("utf-8", "replace") for p in pieces}
        by_width: dict[int, list[str]] = {}
        for p, b in new.items():
            if len(b) > LONG:
                self.known[p] = self.merge_long(b)
            else:
                by_width.setdefault(next(w for w in WIDTHS if len(b) <= w), []).append(p)
        for width, ps in by_width.items():
            sizes = np.array([len(new[p]) for p in ps])
            parts = np.full((len(ps), width), -1, np.int32)
            parts[np.arange(width)[None, :] < sizes[:, None]] = self.id_of_byte[np.frombuffer(b"".join(new[p] for p in ps), np.uint8)]
            self.known.update(zip(ps, self.merge_rows(parts), strict=True))

    def find(self, text: str) -> list[str]:
        return (self.piece if NOT_PLAIN.search(text) else PLAIN).findall(text)

    def pieces(self, text: str) -> Iterator[list[str] | bytes]:
        """A text's pieces in slices; a special token comes as its id's bytes."""
        start = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text[start : m.start()])
            yield int(self.specials[m.group()]).to_bytes(4, "little")
            start = m.end()
        yield from self._plain(text[start:] if start else text)

    def _plain(self, text: str) -> Iterator[list[str]]:
        if len(text) <= SLICE:  # not more pieces than characters
            if text:
                yield self.find(text)
            return
        found = (m.group() for m in self.piece.finditer(text))
        while some := list(islice(found, SLICE)):
            yield some

    def _ids(self, pieces: list[str] | bytes) -> bytes:
        if isinstance(pieces, bytes):
            return pieces
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self.learn(set(pieces))
            return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text in slices, each as little-endian unsigned 32-bit integers."""
        return map(self._ids, self.pieces(text))

    def encode_all(self, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
        """``encode`` of several texts in order; short ones learn their new pieces together."""
        held: list[list[list[str] | bytes]] = []
        size = 0
        for text in texts:
            if len(text) > SLICE:
                yield from self._drain(held)
                held, size = [], 0
                yield self.encode(text)
                continue
            held.append(list(self.pieces(text)))
            size += len(text)
            if size > 8 * SLICE:
                yield from self._drain(held)
                held, size = [], 0
        yield from self._drain(held)

    def _drain(self, held: list[list[list[str] | bytes]]) -> Iterator[Iterator[bytes]]:
        new: set[str] = set()
        for slices in held:
            for pieces in slices:
                if not isinstance(pieces, bytes):
                    new.update(pieces)
        self.learn(new)
        for slices in held:
            yield map(self._ids, slices)

    def decode(self, ids: Iterable[bytes]) -> Iterator[str]:
        """Texts of slices of ids; bytes that end inside a character wait for the next slice."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for part in ids:
            yield decoder.decode(b"".join(map(self.bytes_of.__getitem__, np.frombuffer(part, "<u4").tolist())))
        yield decoder.decode(b"", True)

    def digests(self, slices: Iterable[bytes]) -> tuple[int, str, str]:
        """Of an encoded text: number of ids, digest of the ids, digest of the text decoded from them."""
        n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()

        def counted() -> Iterator[bytes]:
            nonlocal n
            for part in slices:
                n += len(part) // 4
                ids_digest.update(part)
                yield part

        for part in self.decode(counted()):
            text_digest.update(part.encode())
        return n, ids_digest.hexdigest(), text_digest.hexdigest()


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): every text as an array of token ids."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in c.encode_all(t.as_py() or "" for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return picked.mapInArrow(work, f"id {picked.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_column(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(id, text): the texts of ``encode_column``."""
    small_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            texts = ["".join(c.decode([np.array(ids or [], "<u4").tobytes()])) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.select("id", "ids").mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def token_digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded in one pass."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            rows = list(map(c.digests, c.encode_all(t.as_py() or "" for t in b.column(1))))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(work, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
