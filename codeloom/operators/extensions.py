"""Extractors and embedding providers from outside.

An extractor for a language is a Python table function: ``eval(path, content)`` yields rows of
``SCHEMA``. It is called laterally, so each file goes through it in its own task, beside the built-in
readers. Embedding providers follow ``embeddings.Provider``.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import extract

SCHEMA = "type string, name string, qualified_name string, line_start int, line_end int"


class Extractor(Protocol):
    """A table function's class: yields (type, name, qualified_name, line_start, line_end) of a file; ``qualified_name`` may be None."""

    def eval(self, path: str, content: str): ...


class Registry:
    """Extractors by language, for one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def register(self, language: str, extractor: type[Extractor]) -> None:
        name = "extract_" + "".join(c if c.isalnum() else "_" for c in language)
        self.spark.udtf.register(name, F.udtf(extractor, returnType=SCHEMA))
        self.known[language] = name

    def facts(self, files: DataFrame) -> DataFrame | None:
        """Node facts of the files (path, language, content) in registered languages; None without any."""
        found = []
        for language, name in sorted(self.known.items()):
            own = files.where(F.col("language") == language).select("path", "content")
            rows = self.spark.sql(f"select f.path, t.* from {{files}} f, lateral {name}(f.path, f.content) t", files=own)
            whole = F.coalesce("qualified_name", F.concat("path", F.lit("::"), "name"))
            found.append(extract._facts(rows, "node", type=F.col("type"), name=F.col("name"), qualified_name=whole, line_start=F.col("line_start"), line_end=F.col("line_end"), metadata=extract._json(parser=F.lit(language))))
        return reduce(DataFrame.unionByName, found) if found else None


def facts(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """All facts of files, those of registered languages included."""
    own = registry.facts(files) if registry else None
    built_in = extract.facts(files)
    return built_in if own is None else built_in.unionByName(own)
