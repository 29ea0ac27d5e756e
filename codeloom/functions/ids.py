"""Content-addressed keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def stable_hash(*parts: Column, length: int = 16) -> Column:
    """Start of the SHA-256 of the parts; a null part reads ``None``."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.left(F.sha2(F.concat_ws(SEPARATOR, *texts), 256), F.lit(length))


def node_id(kind: Column, qualified_name: Column) -> Column:
    return F.concat(kind, F.lit(":"), stable_hash(kind, qualified_name, length=24))


def edge_id(source: Column, target: Column, kind: Column, provenance: Column) -> Column:
    return F.concat(F.lit("edge:"), stable_hash(source, target, kind, provenance, length=24))


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(F.lit("chunk:"), stable_hash(path, start, end, F.sha2(content, 256), length=24))


def normalize_path(path: Column, compatible: bool = False) -> Column:
    """Without a leading ``./``; ``compatible`` strips every leading dot and slash."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+" if compatible else r"^(\./)+", "")
