"""Generators of test data; distributions are given, values follow Spark's seeded random functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gamma(shape: int, scale: float, seed: int) -> Column:
    """Gamma variates of whole shape: sums of exponential ones."""
    return -scale * sum((F.ln(1 - F.rand(seed + i)) for i in range(1, shape)), F.ln(1 - F.rand(seed)))


def zipf_corpus(spark: SparkSession, n: int, vocabulary: int = 5000, shape: int = 2, scale: float = 25.0, least: int = 5, most: int = 200, seed: int = 42) -> DataFrame:
    """doc_id, text of `term_i` words; ranks fall off as 1/rank, lengths are gamma variates within bounds."""
    rank = F.least(F.floor(F.pow(F.lit(float(vocabulary)), F.rand(seed))), F.lit(vocabulary - 1))
    size = F.least(F.greatest(F.floor(gamma(shape, scale, seed + 1)), F.lit(least)), F.lit(most)).cast("int")
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), size)).alias("i"))
    d = d.select("doc_id", "i", F.concat(F.lit("term_"), rank.cast("string")).alias("w"))
    return d.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("text"))


def zipf_queries(spark: SparkSession, n: int, vocabulary: int = 5000, seed: int = 43) -> DataFrame:
    """qid, text: words of the most frequent quarter of the vocabulary, gamma(1, 3) of them, 1 to 10."""
    return zipf_corpus(spark, n, max(2, vocabulary // 4), 1, 3.0, 1, 10, seed).withColumnRenamed("doc_id", "qid")


def clustered_vectors(spark: SparkSession, n: int, dim: int = 64, clusters: int = 50, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """vec_id, label, embedding of unit length around hashed cluster centres."""
    label = F.pmod(F.col("id"), F.lit(max(1, min(clusters, n)))).cast("int")

    def coordinate(i: int) -> Column:
        centre = F.pmod(F.xxhash64(label, F.lit(i), F.lit(seed)), F.lit(2001)) / 1000.0 - 1
        return centre + noise * F.randn(seed + i)

    d = spark.range(n).select(F.col("id").alias("vec_id"), label.alias("label"), F.array(*[coordinate(i) for i in range(dim)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return d.select("vec_id", "label", F.transform("v", lambda x: (x / norm).cast("float")).alias("embedding"))


def scores(spark: SparkSession, n: int, kind: str = "normal", seed: int = 42) -> DataFrame:
    """id, score of a normal, uniform, zipf or bimodal distribution."""
    value = {
        "normal": F.randn(seed),
        "uniform": F.rand(seed),
        "zipf": 1 / F.floor(F.pow(F.lit(float(n)), F.rand(seed))),
        "bimodal": F.when(F.rand(seed + 1) < 0.5, F.randn(seed) - 2).otherwise(F.randn(seed) + 2),
    }[kind]
    return spark.range(n).select("id", value.cast("float").alias("score"))
