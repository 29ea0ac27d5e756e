"""Fixity audit of WARC replicas by Merkle trees.

Records are hashed where they lie; only hashes move. A file's tree has a leaf for each range
of ``SPAN`` bytes of offsets, which hashes the offsets and hashes of the records that start
there, and above it ``FANOUT`` children to a node up to one root. Two replicas are compared
by their roots; below a root that differs only the branches that differ are looked at, down
to the records.

Defined cases: null data hashes as empty data; a null file is a file of its own; a record
that one replica lacks is ``missing`` (from the second) or ``extra`` (in the second), one
whose bytes differ ``changed``; records that share file and offset are hashed together in
order of their hashes and reported as one place; empty tables have no roots, so every record
of the other replica is reported; only the named columns are read.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.common import cut, small_batches

SPAN = 1 << 16
FANOUT = 16


def _sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def digest(data: Column) -> Column:
    return F.sha2(F.coalesce(data.cast("binary"), F.lit("").cast("binary")), 256)


def leaves(records: DataFrame, file: str = "file", offset: str = "offset", data: str = "data") -> DataFrame:
    """(file, offset, hash, n): one row for each place of a replica; ``digest`` may come in place of the data."""
    h = F.col("digest") if data not in records.columns else digest(F.col(data))
    hashed = records.select(F.coalesce(F.concat(F.lit("f"), F.col(file)), F.lit("null")).alias("file"), F.col(offset).cast("long").alias("offset"), h.alias("h"))
    return hashed.groupBy("file", "offset").agg(F.count("*").alias("n"), _sha(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("hash"))


def _node(rows: DataFrame, width: int, place: str) -> DataFrame:
    """One level up: (file, at, hash) over ``width`` neighbours of ``place``."""
    at = F.floor(F.col(place) / F.lit(width)).cast("long") if width != 1 else F.col(place)
    child = F.struct(F.col(place).alias("place"), F.hex("hash").alias("hash"))
    parts = F.transform(F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(":", c["place"].cast("string"), c["hash"]))
    return rows.groupBy("file", at.alias("at")).agg(_sha(F.array_join(parts, "\n")).alias("hash"))


def tree(found: DataFrame, height: int, span: int = SPAN, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (file, at, hash), from the offset ranges up to the roots."""
    levels = [_node(found, span, "offset")]
    for _ in range(height):
        levels.append(_node(levels[-1], fanout, "at"))
    return levels


def height_of(*replicas: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> int:
    """Levels above the ranges that give every file one root."""
    end = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas)
    ranges, height = end // span, 0
    while ranges > 0:
        ranges //= fanout
        height += 1
    return height


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x = a.select(*keys, F.col("hash").alias("hash_a"))
    y = b.select(*keys, F.col("hash").alias("hash_b"))
    return x.join(y, keys, "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(first: DataFrame, second: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, status) of every place where the second replica isn't the first's copy."""
    a, b = cut(leaves(first)), cut(leaves(second))
    height = height_of(a, b, span=span, fanout=fanout)
    up_a, up_b = [cut(x) for x in tree(a, height, span, fanout)], [cut(x) for x in tree(b, height, span, fanout)]
    bad = _differing(up_a[-1], up_b[-1], ["file", "at"]).select("file", "at")
    for k in range(height - 1, -1, -1):
        under = lambda rows: rows.withColumn("up", F.floor(F.col("at") / F.lit(fanout)).cast("long")).join(bad.select("file", F.col("at").alias("up")), ["file", "up"], "left_semi")  # noqa: B023, E731
        bad = _differing(under(up_a[k]), under(up_b[k]), ["file", "at"]).select("file", "at")
    inside = lambda rows: rows.withColumn("at", F.floor(F.col("offset") / F.lit(span)).cast("long")).join(bad, ["file", "at"], "left_semi")
    found = _differing(inside(a), inside(b), ["file", "offset"])
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return found.select(F.when(F.col("file") != "null", F.substring("file", 2, 1 << 30)).alias("file"), "offset", status.alias("status"))


def roots(records: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """(file, root) of one replica, to be kept beside it."""
    found = cut(leaves(records))
    top = tree(found, height_of(found, span=span, fanout=fanout), span, fanout)[-1]
    return top.select(F.when(F.col("file") != "null", F.substring("file", 2, 1 << 30)).alias("file"), F.hex("hash").alias("root"))


HEADER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{id}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"


def warc_records(pages: DataFrame, per_file: int = 500) -> DataFrame:
    """(page_id, file, data): pages as WARC response records, in files of ``per_file`` pages by id."""
    html = F.coalesce("html", F.lit(""))
    head = F.lit("")
    for k, part in enumerate(HEADER.replace("{", "}").split("}")):
        head = F.concat(head, F.lit(part) if k % 2 == 0 else {"id": F.col("page_id").cast("string"), "url": F.coalesce("url", F.lit("")), "n": F.octet_length(html).cast("string")}[part])
    data = F.encode(F.concat(head, html, F.lit("\r\n\r\n")), "UTF-8")
    number = F.floor(F.col("page_id") / F.lit(per_file)).cast("long")
    return pages.select("page_id", F.format_string("pages-%06d.warc", number).alias("file"), data.alias("data"))


def placed(records: DataFrame, order: str = "page_id") -> DataFrame:
    """(order, file, offset, digest): where records lie that stand in their files in this order.

    Data is hashed before rows move; a file's rows come together, without their data.
    """
    before = W.partitionBy("file").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sized = records.select(order, "file", F.octet_length("data").cast("long").alias("size"), digest(F.col("data")).alias("digest"))
    return sized.select(order, "file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), "digest")


def parse_warc(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of a WARC file's bytes; of a compressed one, offset and bytes of the unpacked stream."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        head = content.find(b"\r\n\r\n", at)
        if head < 0:
            return
        size = next((int(x.partition(b":")[2]) for x in content[at:head].split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        end = min(head + 4 + size + 4, len(content))
        yield at, content[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, data) of the records of WARC files, which a path or pattern names."""
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                for at, record in parse_warc(content.as_py()):
                    yield pa.RecordBatch.from_arrays([name.as_py() and pa.array([name.as_py().rsplit("/", 1)[-1]]), pa.array([at], pa.int64()), pa.array([record], pa.binary())], ["file", "offset", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, "file string, offset long, data binary")
