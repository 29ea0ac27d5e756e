"""From raw documents to token digests: five stages, each over what the one before it kept.

A stage takes the documents its predecessor kept and returns them with the columns of
``documents``; the last returns token digests instead. Between the stages the rows are cut
from their lineage in the shared checkpoint folder. Rows with null or repeated ids, null
texts and empty tables go through as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, chunks, decontaminate, ordered_minhash, quality
from codeloom.llm.common import cut, table
from codeloom.llm.queries import vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut texts; ``n_chars`` follows them."""
    return chunks.dedup_passages(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ordered_minhash.keep_one(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, vocabulary())


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_each_group),
    ("decontamination", without_test_items),
    ("bpe", tokens),
]

#: Order min-hash and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
