"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next one's docs. All but the last return
the columns of docs; sharding adds shard_id.

Null and empty texts fail the quality rules. Repeated rows are copies of each other: one stays. An id that
comes with different texts, or a null one, names nothing: each text is judged by itself, and rows of equal texts and
ids share a shard and a fate. Of equal candidates the smallest id stays, null last, then the text of the least
hash. Texts of any length go through whole. An empty table gives an empty one with the same columns; columns
that the stages don't know, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.decontamination import clean_documents
from lodestar.llm.mixing import mix_documents
from lodestar.llm.quality_rules import filter_documents
from lodestar.llm.sharding import shard_documents
from lodestar.llm.simhash import one_of_each
from lodestar.runtime import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash links one document stays, that of the smallest id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, edited or not, go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept or passed over to meet their source's target."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes; equal texts share one."""
    return shard_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs


#: XXH64 fingerprints, alignments and differencing have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None
