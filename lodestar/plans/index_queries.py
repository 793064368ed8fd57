"""Queries over what is kept and brought up to date: indexes, results, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import docstore as D
from ..operators import index as I
from ..operators import monitoring as N
from ..operators import results as R
from ..operators import scoring as S
from ..operators import segments as G
from ..runtime import materialise, scratch_path
from .analytics_queries import _LOG, log
from .retrieval_queries import ORACLE_SQL as _RETRIEVAL
from .retrieval_queries import docs, queries


def _upserted(spark, d: str) -> I.Index:
    """The index of documents after two upserts: every tenth text is turned round and some documents come anew, then
    some of both are written again."""
    at, now = scratch_path(spark, "segments"), docs(spark, d)
    first = now.filter("doc_id % 10 = 3").withColumn("text", F.reverse("text"))
    first = first.unionByName(now.filter("doc_id % 50 = 1").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))
    G.save(now, at, "own")
    G.upsert(now, first, at, "own")
    now = materialise(D.upsert(now, first), "documents")
    second = now.filter("doc_id % 100 IN (1, 13, 77)").withColumn("text", F.concat("text", F.lit(" once more")))
    G.upsert(now, second, at, "own")
    return G.load(spark, at, "own")


def upsert_search(spark, d: str) -> DataFrame:
    """A search of an index that was brought up to date, segment by segment."""
    return S.bm25(_upserted(spark, d), queries(spark, d))


def upsert_term_stats(spark, d: str) -> DataFrame:
    """term, df, n and the average length after the upserts."""
    i = _upserted(spark, d)
    return i.terms.join(F.broadcast(i.stats)).select("term", "df", F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"))


def cached_search(spark, d: str) -> DataFrame:
    """A search of half of the queries, then of all: only the others are scored."""
    corpus, asked = docs(spark, d), queries(spark, d)
    R.searched(S.bm25, corpus, asked.filter("qid % 2 = 0"))
    return R.searched(S.bm25, corpus, asked)


def sketched_latency(spark, d: str) -> DataFrame:
    """Percentiles of each weekday's days and of all, from merged daily sketches, and whether their ranks among all rows keep to the stated error."""
    own = log(spark, d).filter("NOT failed AND latency_ms IS NOT NULL")
    days = materialise(N.daily_sketches(own), "sketches").withColumn("weekday", F.dayofweek("day"))
    found = N.sketched_percentiles(days, (0.5, 0.95, 0.99), "weekday").unionByName(N.sketched_percentiles(days).withColumn("weekday", F.lit(0)))
    found = F.broadcast(materialise(found, "quantiles"))  # three rows a weekday
    rows = own.select(F.dayofweek("ts").alias("_w"), "latency_ms")
    rows = rows.join(found, (F.col("weekday") == 0) | (F.col("weekday") == F.col("_w")))
    ranks = rows.groupBy("weekday", "p", "n").agg((F.count_if(F.col("latency_ms") < F.col("v")) / F.col("n")).alias("lo"), (F.count_if(F.col("latency_ms") <= F.col("v")) / F.col("n")).alias("hi"))
    near = (F.col("lo") <= F.col("p") + N.SKETCH_ERROR) & (F.col("hi") >= F.col("p") - N.SKETCH_ERROR)
    return ranks.select(F.col("weekday").cast("long").alias("weekday"), "p", "n", near.alias("within"))


QUERIES = {f.__name__: f for f in (upsert_search, upsert_term_stats, cached_search, sketched_latency)}

_FIRST = "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN reverse(text) ELSE text END AS text FROM documents UNION ALL SELECT doc_id + 10000000, text FROM documents WHERE doc_id % 50 = 1"
_SECOND = f"(SELECT doc_id, CASE WHEN doc_id % 100 IN (1, 13, 77) THEN text || ' once more' ELSE text END AS text FROM ({_FIRST}))"

ORACLE_SQL = {
    "sketched_latency": f"""WITH {_LOG}, r AS (SELECT dayofweek(ts) + 1 AS w FROM lg WHERE NOT failed AND latency_ms IS NOT NULL), g AS (SELECT w, count(*) AS n FROM r GROUP BY w UNION ALL SELECT 0, count(*) FROM r)
SELECT w AS weekday, p, n, true AS within FROM g, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS p) WHERE n > 0""",
    "cached_search": _RETRIEVAL["bm25_topk"],
    "upsert_search": _RETRIEVAL["bm25_topk"].replace("FROM documents", f"FROM {_SECOND}"),
    "upsert_term_stats": _RETRIEVAL["bm25_topk"].partition("s_run AS")[0].rstrip(" ,\n").replace("FROM documents", f"FROM {_SECOND}") + " SELECT term, df, n AS n_docs, round(avgdl, 6) AS avgdl FROM df, st",
}
