"""Queries over binary corpora and raw vector files that they write first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch_path, table
from ..sources import binary


def _corpus(spark, d: str) -> str:
    at = scratch_path(binary.register(spark), "binary-corpus")
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("source").alias("title"))
    own.write.format("lodestar_corpus").mode("append").save(at)
    return at


def binary_round_trip(spark, d: str) -> DataFrame:
    """Documents written as binary records and read again."""
    found = spark.read.format("lodestar_corpus").load(_corpus(spark, d))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"), "title")


def binary_lookup(spark, d: str) -> DataFrame:
    """Some documents of a binary corpus, by id; the others are not inflated."""
    found = spark.read.format("lodestar_corpus").load(_corpus(spark, d)).filter(F.col("doc_id").isin("3", "77", "150", "no such id"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


def binary_totals(spark, d: str) -> DataFrame:
    """The totals that a corpus is committed with."""
    found = spark.read.schema("records long, text_bytes long").option("multiLine", True).json(f"{_corpus(spark, d)}/{binary.LIST}")
    return found.select(F.col("records").alias("total_docs"), F.round(F.col("text_bytes") / F.col("records"), 6).alias("avg_doc_length"))


def raw_vector_file(spark, d: str) -> DataFrame:
    """Vectors written as bare float32 values, in order of their ids, and read by place."""
    at = scratch_path(binary.register(spark), "raw-vectors")
    own = table(spark, d, "embeddings").select("vec_id", "embedding")
    own.repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.format("lodestar_vectors").mode("append").save(at)
    found = spark.read.format("lodestar_vectors").load(at)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(total, 6).alias("total"), F.col("embedding")[0].cast("double").alias("first"))


QUERIES = {f.__name__: f for f in (binary_round_trip, binary_lookup, binary_totals, raw_vector_file)}

ORACLE_SQL = {
    "binary_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, strlen(coalesce(text, ''))::BIGINT AS n_bytes, coalesce(source, '') AS title FROM documents",
    "binary_lookup": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents WHERE doc_id IN (3, 77, 150)",
    "binary_totals": "SELECT count(*) AS total_docs, round(sum(strlen(coalesce(text, ''))) / count(*), 6) AS avg_doc_length FROM documents",
    "raw_vector_file": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, len(embedding) AS dim, round(list_sum([x::DOUBLE for x in embedding]), 6) AS total, embedding[1]::DOUBLE AS first FROM embeddings",
}
