"""Integer vectors, dealt into blocks that numpy works on.

A component x becomes floor(``SCALE`` * x), x as double. A vector that is null, or holds a null or
non-finite component or one beyond ``LARGEST`` after scaling, takes no part: sums of products of
larger numbers wouldn't fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
LARGEST = 1 << 27
#: Vectors in one block. A worker holds a batch of blocks, so a block stays small.
BLOCK_ROWS = 512


def integer_vectors(rows: DataFrame, key: str, vector: str, components: int | None = None) -> DataFrame:
    """(id, v array<int>) of the vectors that take part; ``components``: only those of exactly so many."""
    # as arrays of doubles, whatever the components are stored as
    scaled = rows.select(F.col(key).try_cast("long").alias("id"), F.transform(vector, lambda x: F.lit(float(SCALE)) * x.cast("double")).alias("x"))
    good = F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)) & (F.size("x") > 0)
    if components is not None:
        good &= F.size("x") == components
    return scaled.where(F.coalesce(good, F.lit(False))).select("id", F.transform("x", lambda x: F.floor(x).cast("int")).alias("v"))


def matrix_of(column: pa.Array, components: int) -> np.ndarray:
    """Rows of a list column of equally long lists, as 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


def packed_matrix(x: np.ndarray) -> bytes:
    return x.astype("<i4").tobytes()


def read_matrix(data: bytes, components: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").astype(np.int64).reshape(-1, components)


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch whose lists of ``column`` are equally long, in order, at most ``BLOCK_ROWS`` rows each."""
    sizes = np.array([len(x) for x in batch.column(column)], np.int64)
    at = 0
    while at < len(sizes):
        end = at + 1
        while end < len(sizes) and sizes[end] == sizes[at] and end - at < BLOCK_ROWS:
            end += 1
        yield int(sizes[at]), batch.slice(at, end - at)
        at = end
