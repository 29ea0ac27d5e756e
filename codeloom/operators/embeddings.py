"""Vectors of nodes and chunks: providers, and upkeep that embeds only what is new or changed.

A record is (entity_id, entity_type, text, file_path). A stored row adds provider, model,
dimensions, content_hash and vector. A record is embedded again only if no stored row has its
entity, provider, model and content hash, so a second run over the same records embeds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256
from itertools import batched, chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import search
from codeloom.operators.checkpoints import cut

DIMENSIONS = 256
#: What a token is, and the weights of tokens, their parts and pairs of neighbours.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
PART = "[a-z]+|[0-9]+"
WEIGHTS = (1.0, 0.75, 0.5)
#: Texts whose features a worker holds at a time, and features of these that it hashes in one go.
TEXTS, REMEMBERED = 128, 1 << 14
#: Hashes of features in UTF-8.
Number = Callable[[Iterable[bytes]], np.ndarray]


class Provider(Protocol):
    """What turns texts into vectors. ``vectors`` takes (entity_id, text) and returns (entity_id, vector array<double>), one row each."""

    name: str
    model: str
    dimensions: int

    def vectors(self, records: DataFrame) -> DataFrame: ...

    def of_text(self, text: str) -> list[float]: ...


def _hashed(records: DataFrame, number: Number, size: int) -> DataFrame:
    """(entity_id, vector) of (entity_id, text) by hashed features, in Arrow batches of which ``TEXTS`` are in work at a time; rows aren't shuffled."""
    kind = records.schema["entity_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, TEXTS) for k in range(0, b.num_rows, TEXTS)):
                flat = _vectors(part.column(1).to_pylist(), number, size).reshape(-1)
                ends = pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], ["entity_id", "vector"])

    return records.select("entity_id", "text").mapInArrow(work, f"entity_id {kind}, vector array<double>")


@dataclass(frozen=True)
class DigestHash:
    """Signed feature hashing by the first 60 bits of SHA-256, which SQL has too."""

    dimensions: int = DIMENSIONS
    name: str = "digest-hash"
    model: str = "sha256-60bit"

    def vectors(self, records: DataFrame) -> DataFrame:
        return _hashed(records, _sha, self.dimensions)

    def of_text(self, text: str) -> list[float]:
        return _vectors([text], _sha, self.dimensions)[0].tolist()


@dataclass(frozen=True)
class LocalHash:
    """Signed feature hashing by 64 bits of BLAKE2b."""

    dimensions: int = DIMENSIONS
    name: str = "local-hash"
    model: str = f"blake2b-{DIMENSIONS}"

    def vectors(self, records: DataFrame) -> DataFrame:
        return _hashed(records, _blake, self.dimensions)

    def of_text(self, text: str) -> list[float]:
        return _vectors([text], _blake, self.dimensions)[0].tolist()


_TOKENS, _PARTS = re.compile(TOKEN), re.compile(PART)


def _blake(features: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([blake2b(f, digest_size=8).digest() for f in features]), ">u8")


def _sha(features: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([sha256(f).digest()[:8] for f in features]), ">u8") >> np.uint64(4)


def _places(features: Iterable[bytes], number: Number, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and sign of each feature."""
    h = np.concatenate([np.empty(0, np.uint64), *map(number, batched(features, REMEMBERED))]).astype(np.uint64)
    return (h % np.uint64(size)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0)


def _vectors(texts: list[str | None], number: Number, size: int) -> np.ndarray:
    """One unit vector a text, or zeros: tokens, their parts and pairs of neighbours, of which each different one is hashed once."""
    place: dict[str, int] = {}
    found = [[place.setdefault(w, len(place)) for w in map(str.lower, _TOKENS.findall(t or ""))] for t in texts]
    code, row = np.fromiter(chain.from_iterable(found), np.int64), np.repeat(np.arange(len(texts)), [len(f) for f in found])
    words = [w.encode() for w in place]
    out = np.zeros(len(texts) * size)

    def add(rows: np.ndarray, at: np.ndarray, places: tuple[np.ndarray, np.ndarray], weight: float) -> None:
        np.add(out, np.bincount(rows * size + places[0][at], places[1][at] * weight, len(out)), out=out)

    add(row, code, _places(words, number, size), WEIGHTS[0])
    parts: dict[str, int] = {}
    of_word = [[parts.setdefault(p, len(parts)) for p in _PARTS.findall(w)] for w in place]
    n_parts = np.array([len(p) for p in of_word], np.int64)
    flat, first = np.fromiter(chain.from_iterable(of_word), np.int64), np.cumsum(n_parts) - n_parts
    n = n_parts[code]
    add(np.repeat(row, n), flat[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())], _places((f"part:{p}".encode() for p in parts), number, size), WEIGHTS[1])
    inside = row[1:] == row[:-1]
    pairs, at = np.unique((code[:-1] * len(words) + code[1:])[inside], return_inverse=True)
    add(row[1:][inside], at, _places((words[a] + b"::" + words[b] for a, b in zip(*(x.tolist() for x in divmod(pairs, max(len(words), 1))), strict=True)), number, size), WEIGHTS[2])
    out = out.reshape(len(texts), size)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def marked(records: DataFrame, provider: Provider) -> DataFrame:
    """Records with what identifies a stored vector."""
    return records.withColumns({"provider": F.lit(provider.name), "model": F.lit(provider.model), "dimensions": F.lit(provider.dimensions), "content_hash": F.sha2(F.coalesce("text", F.lit("")), 256)})


KEY = ["entity_id", "provider", "model", "content_hash"]


def delta(records: DataFrame, stored: DataFrame, provider: Provider) -> DataFrame:
    """The records, marked, that no stored vector covers; of repeated entities the one with the greatest text."""
    once = records.groupBy("entity_id").agg(F.max(F.struct(F.col("text"), *[c for c in records.columns if c not in ("entity_id", "text")])).alias("r")).select("entity_id", "r.*")
    return marked(once, provider).join(stored.select(*KEY), KEY, "left_anti")


def embedded(records: DataFrame, provider: Provider) -> DataFrame:
    """Marked records with their vectors; ids must be unique. The whole record goes along as the id, so that nothing is joined."""
    found = provider.vectors(records.select(F.struct(*records.columns).alias("entity_id"), "text"))
    return found.select("entity_id.*", "vector")


def upkeep(records: DataFrame, stored: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(all rows that should be stored, the rows among them that were embedded now).

    Stored rows stay if the entity is still among the records, or if they are another provider's.
    """
    new = cut(embedded(delta(records, stored, provider), provider))  # both results read it
    own = (F.col("provider") == provider.name) & (F.col("model") == provider.model)
    now = marked(records, provider).select(*KEY).distinct()
    kept = stored.where(~own).unionByName(stored.where(own).join(now, KEY, "left_semi").select(stored.columns))
    return kept.unionByName(new, allowMissingColumns=True), new


def semantic(stored: DataFrame, query: str, limit: int = 10, provider: Provider | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """The nearest entities to a query's words among one provider's vectors, with ``score``; none for a blank query."""
    provider = provider or LocalHash()
    own = stored.where((F.col("provider") == provider.name) & (F.col("model") == provider.model))
    if types:
        own = own.where(F.col("entity_type").isin(*types))
    if not query.strip():
        return own.withColumn("score", F.lit(0.0)).limit(0)
    return search.nearest(own, provider.of_text(query), limit, vector="vector", key="entity_id")
