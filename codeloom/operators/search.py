"""Exact, full-text, vector and hybrid search over frames of nodes, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import tokens


def terms(query: str) -> list[str]:
    """Words of a query; colons and slashes separate words too."""
    return [t for t in (x.replace('"', "") for x in query.replace(":", " ").replace("/", " ").split()) if t]


def _holds_phrase(words: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(words, phrase[0])
    padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.contains(padded, F.lit(" " + " ".join(phrase) + " "))


def phrase_of(term: str) -> list[str]:
    """A term as the tokenizer splits it."""
    out, word = [], ""
    for c in term.lower():
        if c.isalnum():
            word += c
        elif word:
            out, word = [*out, word], ""
    return [*out, word] if word else out


def full_text(rows: DataFrame, query: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows where any term of the query stands, as a phrase of tokens, in any column."""
    hit = F.lit(False)
    phrases = [p for p in map(phrase_of, terms(query)) if p]
    for c in columns:
        words = tokens(F.coalesce(c, F.lit("")))
        for p in phrases:
            hit = hit | _holds_phrase(words, p)
    return rows.where(hit)


def like(rows: DataFrame, query: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows with the query inside a column, whatever the case of ASCII letters."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
    return rows.where(hit)


def full_text_or_like(rows: DataFrame, query: str, columns: tuple[str, ...]) -> DataFrame:
    found = full_text(rows, query, columns)
    return like(rows, query, columns) if found.isEmpty() else found


def find_nodes(nodes: DataFrame, query: str, limit: int = 20, columns: tuple[str, ...] = ("name", "qualified_name")) -> DataFrame:
    """Exact hits first, then full-text hits, each node once; ties by id."""
    exact = nodes.where((F.col("qualified_name") == query) | (F.col("name") == query) | (F.coalesce("file_path", F.lit("")) == query))
    ranked = exact.withColumn("source", F.lit(0)).unionByName(full_text_or_like(nodes, query, columns).withColumn("source", F.lit(1)))
    first = ranked.groupBy(*nodes.columns).agg(F.min("source").alias("source"))
    return first.orderBy("source", "id").limit(limit)


def rank_nodes(nodes: DataFrame, query: str) -> DataFrame:
    inside = F.when(F.contains(F.lower("qualified_name"), F.lit(query.lower())), 2).otherwise(0)
    extracted = F.when(F.col("confidence_tier") == "extracted", 1).otherwise(0)
    return nodes.withColumn("inside", inside).withColumn("extracted", extracted).orderBy(F.desc("inside"), F.desc("extracted"), F.desc("qualified_name"))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, for vectors of unequal size, and for those without length."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + x * x))
    length = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (length == 0), zero).otherwise(F.try_divide(dot, length))


def nearest(vectors: DataFrame, query: list[float], limit: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The rows with the highest positive cosine; ties by key. The query is a literal, so no join is needed."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", cosine(F.transform(vector, lambda x: x.cast("double")), q)).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(limit)


def relevant_memories(memories: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Memories that hold any of the query's first six longer words; all if the query has none. Newest first."""
    words = [w for w in query.lower().split() if len(w) > 2][:6]
    hit = F.lit(not words)
    for w in words:
        hit = hit | F.lower("content").like(f"%{w}%") | F.lower("kind").like(f"%{w}%")
    return memories.where(hit).orderBy(F.desc("created"), F.desc("id")).limit(limit)
