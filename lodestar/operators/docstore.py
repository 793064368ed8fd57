"""Document store operations on a Parquet table of doc_id, text, and whatever else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import ws_tokens
from .index import sized

#: Folders of a saved store, and ids that a look-up gives to the scan one by one, at most.
BUCKETS, LISTED = 64, 200


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """old and new by key, new rows win. new has each key once or the larger ord wins, if it has ord."""
    order = [F.desc("_new")] + ([F.desc("ord")] if "ord" in new.columns else [])
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(*order)
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new", *(["ord"] if "ord" not in old.columns else []))


def get_documents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, doc_id) with the text, null where there is none; pos keeps the order asked for."""
    return wanted.join(docs.select("doc_id", "text"), "doc_id", "left").select("pos", "doc_id", "text")


def contains(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, whether the store has it."""
    known = docs.select(F.col("doc_id").alias("_id")).distinct()
    return wanted.join(known, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.col("_id").isNotNull().alias("present"))


def batch(docs: DataFrame, start: int, n: int) -> DataFrame:
    """Documents start to start + n - 1 by id; fewer at the end."""
    return docs.orderBy("doc_id").offset(start).limit(n)


def first_k_reciprocal(docs: DataFrame, k: int) -> DataFrame:
    """The first k documents by id with score 1 / place."""
    top = docs.select("doc_id").orderBy("doc_id").limit(k)
    return top.select("doc_id", F.round(1 / F.row_number().over(Window.orderBy("doc_id")), 6).alias("score"))


def store_stats(docs: DataFrame) -> DataFrame:
    """n_docs, mean and total characters."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(n), 6).alias("mean_chars"), F.sum(n).alias("total_chars"))


def byte_stats(docs: DataFrame) -> DataFrame:
    """n_docs, total, mean and largest size of the UTF-8 text."""
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.agg(F.count(F.lit(1)).alias("total_docs"), F.sum(n).alias("total_bytes"), F.round(F.avg(n), 6).alias("avg_doc_length"), F.max(n).alias("max_doc_length"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n_docs, valid ones (id and text there), their white-space tokens and mean length."""
    valid = F.col("doc_id").isNotNull() & (F.length("text") > 0)
    n = F.when(valid, F.size(ws_tokens(F.col("text"), lower=False))).otherwise(0).cast("long")
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid"), F.sum(n).alias("n_tokens"),
        F.round(F.try_divide(F.sum(n), F.count_if(valid)), 6).alias("avg_length"),
    )


def dataset_stats(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: sizes, mean lengths in white-space tokens, lower-cased vocabulary, unknown references. Null for means of nothing."""
    d = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.size(ws_tokens(F.col("text")))), 6).alias("avg_doc_length"))
    q = queries.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.size(ws_tokens(F.col("text")))), 6).alias("avg_query_length"))
    v = docs.select(F.explode(ws_tokens(F.col("text"))).alias("w")).distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    r = qrels.agg(F.count(F.lit(1)).alias("n_qrels"))
    m = missing_refs(docs, queries, qrels)
    m = m.agg(F.count_if(F.col("kind") == "document").alias("missing_docs"), F.count_if(F.col("kind") == "query").alias("missing_queries"))
    return d.crossJoin(q).crossJoin(v).crossJoin(r).crossJoin(m)


def missing_refs(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """kind, id of judged documents and queries that there are not."""
    d = qrels.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    q = qrels.select("qid").distinct().join(queries.select("qid"), "qid", "left_anti").select(F.lit("query").alias("kind"), F.col("qid").alias("id"))
    return d.unionByName(q)


def save(docs: DataFrame, path: str, level: str = "zstd", files: int | None = None, buckets: int = BUCKETS) -> None:
    """Write the store as compressed Parquet, a folder for each bucket of ids, by id within, with a Bloom filter of the ids
    in each row group; files: into how many a bucket is written. Null ids have a bucket of their own."""
    own = docs.withColumn(_BUCKET, bucket_of(F.col("doc_id"), buckets))
    deal = [_BUCKET] if not files or files == 1 else [_BUCKET, F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(files))]
    write = own.repartition(*deal).sortWithinPartitions(_BUCKET, "doc_id").write.mode("overwrite").partitionBy(_BUCKET)
    write.option("compression", level).option("parquet.bloom.filter.enabled#doc_id", "true").parquet(path)


_BUCKET = "_bucket"


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(buckets)), F.lit(buckets)).cast("int")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_BUCKET)


def find(spark: SparkSession, path: str, wanted: DataFrame | list, buckets: int = BUCKETS) -> DataFrame:
    """The documents of a saved store with the wanted ids (doc_id, or a list): only their buckets are read, and of these, for
    LISTED ids or fewer, only the row groups whose Bloom filter or range may have one. Each document once."""
    store = spark.read.parquet(path)
    if not isinstance(wanted, list):
        own = sized(wanted.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").distinct()).withColumn("_b", bucket_of(F.col("_id"), buckets))
        return store.join(own, (F.col(_BUCKET) == F.col("_b")) & (F.col("doc_id") == F.col("_id")), "left_semi").drop(_BUCKET)
    if not wanted:
        return store.limit(0).drop(_BUCKET)
    kind = store.schema["doc_id"].dataType
    at = spark.createDataFrame([(x,) for x in wanted], StructType([StructField("doc_id", kind)])).select(bucket_of(F.col("doc_id"), buckets)).distinct()
    found = F.lit(False)
    for i in range(0, len(wanted), 10):  # so many values of a list reach the scan one by one
        found = found | F.col("doc_id").isin(wanted[i : i + 10])
    found = found if len(wanted) <= LISTED else F.col("doc_id").isin(wanted)
    return store.filter(F.col(_BUCKET).isin([r[0] for r in at.collect()]) & found).drop(_BUCKET)
