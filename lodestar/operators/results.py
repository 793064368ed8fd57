"""Results that are kept: a query that was asked of the same index before is not scored again.

A folder for each index, by content, and for each search, by name and parameters, has the hits of every text asked, and a row for the
asking itself, as some texts have none. New texts are found by an anti-join, searched and appended, texts and hits by one write.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import tokens
from ..runtime import materialise, shared_dir
from .index import _content_key
from .segments import kept


#: Part of the folder's name: to be raised when a search gives other results.
VERSION = 1


def _key() -> Column:
    """What tells a query's text: 256 bits."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def searched(search: Callable[..., DataFrame], docs: DataFrame, queries: DataFrame, k: int = 10, tokenise=tokens, **parameters) -> DataFrame:
    """search(index, queries, k, **parameters) over the index of docs (doc_id, text): qid, doc_id, score, rank of all queries (qid, text),
    of which only texts not asked before are scored."""
    spark = docs.sparkSession
    name = f"{search.__name__}-{k}-" + json.dumps(parameters, sort_keys=True).encode().hex()
    path = f"{shared_dir(spark)}/lodestar/results-{VERSION}/{tokenise.__name__}-{_content_key(docs)}/{name}"
    kinds = StructType([StructField("key", StringType()), docs.schema["doc_id"]]).add("score", "double").add("rank", "long")
    asked = queries.select("qid", _key().alias("key"), "text")
    new = asked.select("key", "text").dropDuplicates(["key"])
    known = _read(spark, path, kinds)
    if known is not None:
        new = new.join(known.filter("rank = 0").select("key"), "key", "left_anti")
    new = materialise(new.select(F.col("key").alias("qid"), "text"), "new-queries")
    if not new.isEmpty():
        hits = search(kept(docs, tokenise), new, k, **parameters).select(F.col("qid").alias("key"), "doc_id", "score", "rank")
        marks = new.select(F.col("qid").alias("key"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
        marks.unionByName(hits).write.mode("append").parquet(path)
        known = _read(spark, path, kinds)
    # a text that two sessions asked at once is there twice
    hits = known.filter("rank > 0").dropDuplicates(["key", "rank"])
    return asked.join(hits, "key").select("qid", "doc_id", "score", "rank")


def _read(spark, path: str, kinds: StructType) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(kinds).parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
