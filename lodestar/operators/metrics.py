"""Metrics of generated answers, of rankings, and of retrieval errors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import metric_tokens
from ..runtime import shipped


def _counted(toks: Column, n: int) -> Column:
    """n-grams of a token array, joined."""
    k = F.greatest(F.size(toks) - (n - 1), F.lit(0))
    g = F.slice(toks, F.lit(1), k)
    for i in range(2, n + 1):
        g = F.zip_with(g, F.slice(toks, F.lit(i), k), lambda a, b: F.concat(a, F.lit(" "), b))
    return g


def overlap(pairs: DataFrame, n: int, *key: str) -> DataFrame:
    """key, clipped n-gram overlap, and how many n-grams each side has. pairs: key, pred, ref."""
    d = pairs.select(*key, metric_tokens(F.col("pred")).alias("_p"), metric_tokens(F.col("ref")).alias("_r"))
    d = d.withColumns({"_pg": _counted(F.col("_p"), n), "_rg": _counted(F.col("_r"), n)})
    # multiset intersection: the left-over of one side shrinks by each gram found in it
    grams = d.select(*key, F.explode(F.concat(F.transform("_pg", lambda g: F.struct(g.alias("g"), F.lit(1).alias("p"), F.lit(0).alias("r"))), F.transform("_rg", lambda g: F.struct(g.alias("g"), F.lit(0).alias("p"), F.lit(1).alias("r"))))).alias("x"))
    both = grams.groupBy(*key, "x.g").agg(F.least(F.sum("x.p"), F.sum("x.r")).alias("c"))
    hit = both.groupBy(*key).agg(F.sum("c").alias("hits"))
    sizes = d.select(*key, F.size("_p").alias("n_pred"), F.size("_r").alias("n_ref"), F.size("_pg").alias("pred_grams"), F.size("_rg").alias("ref_grams"))
    return sizes.join(hit, list(key), "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def _prf(hits: Column, n_pred: Column, n_ref: Column) -> tuple[Column, Column, Column]:
    p = F.when(n_pred > 0, hits / n_pred).otherwise(0.0)
    r = F.when(n_ref > 0, hits / n_ref).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def rouge_n(pairs: DataFrame, n: int, *key: str) -> DataFrame:
    """key, precision, recall, f1; a side too short for n gives 0."""
    p, r, f = _prf(F.col("hits"), F.col("pred_grams"), F.col("ref_grams"))
    return overlap(pairs, n, *key).select(*key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def bleu(pairs: DataFrame, *key: str) -> DataFrame:
    """Sentence BLEU-4 with a linear brevity factor; any order without a hit gives 0."""
    d = None
    for n in range(1, 5):
        o = overlap(pairs, n, *key)
        own = o.select(*key, F.when((F.col("pred_grams") > 0) & (F.col("hits") > 0), F.col("hits") / F.col("pred_grams")).alias(f"p{n}"), *(["n_pred", "n_ref"] if n == 1 else []))
        d = own if d is None else d.join(own, list(key))
    logs = sum((F.ln(f"p{n}") for n in range(2, 5)), F.ln("p1"))
    brevity = F.least(F.lit(1.0), F.when(F.col("n_ref") > 0, F.col("n_pred") / F.col("n_ref")).otherwise(0.0))
    return d.select(*key, F.round(F.coalesce(brevity * F.exp(logs / 4), F.lit(0.0)), 6).alias("bleu"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, a bit for each word of b (Hyyro's recurrence)."""
    where: dict[str, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        u = v & where.get(w, 0)
        v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def rouge_l(pairs: DataFrame, *key: str) -> DataFrame:
    """key, precision, recall, f1 by longest common subsequence; two empty sides agree fully."""
    shipped(pairs)

    @F.pandas_udf("long")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    d = pairs.select(*key, metric_tokens(F.col("pred")).alias("_p"), metric_tokens(F.col("ref")).alias("_r"))
    d = d.withColumns({"hits": lcs("_p", "_r"), "n_pred": F.size("_p"), "n_ref": F.size("_r")})
    none = (F.col("n_pred") == 0) & (F.col("n_ref") == 0)
    cols = [F.round(F.when(none, 1.0).otherwise(c), 6).alias(x) for c, x in zip(_prf(F.col("hits"), F.col("n_pred"), F.col("n_ref")), ("precision", "recall", "f1"), strict=True)]
    return d.select(*key, *cols)


def faithfulness(pred: Column, contexts: Column) -> tuple[Column, Column]:
    """Share of the answer's words that contexts hold, capped at 1, and the number of contexts that hold any."""
    own = F.array_distinct(metric_tokens(pred))
    each = F.transform(contexts, lambda c: F.size(F.array_intersect(own, metric_tokens(c))))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    score = F.when(F.size(own) > 0, F.least(F.lit(1.0), total / F.size(own))).otherwise(0.0)
    return F.round(score, 6), F.size(F.filter(each, lambda x: x > 0)).cast("long")


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """qid, ndcg, ap, recall, precision at k of every judged query; unranked ones score 0.

    Linear gain, log2(rank + 1) discount, an ideal cut at k, AP over all relevant,
    precision over k.
    """
    rel = qrels.filter("rel > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    ideal = rel.withColumn("i", F.row_number().over(w))
    ideal = ideal.groupBy("qid").agg(F.sum(F.when(F.col("i") <= k, F.col("rel") / F.log2(F.col("i") + 1))).alias("ideal"), F.count(F.lit(1)).alias("n_rel"))
    hits = run.filter(F.col("rank") <= k).join(rel, ["qid", "doc_id"])
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("found", F.count(F.lit(1)).over(upto))
    got = hits.groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("found") / F.col("rank")).alias("ap"), F.count(F.lit(1)).alias("n_hit"))
    d = ideal.join(got, "qid", "left").na.fill(0, ["dcg", "ap", "n_hit"])
    return d.select("qid", (F.col("dcg") / F.col("ideal")).alias("ndcg"), (F.col("ap") / F.col("n_rel")).alias("ap"), (F.col("n_hit") / F.col("n_rel")).alias("recall"), (F.col("n_hit") / k).alias("precision"))


def error_categories(predictions: DataFrame, retrieved: DataFrame, qrels: DataFrame) -> DataFrame:
    """qid, category of each prediction (qid). retrieved and qrels: qid, doc_id; judgements of 0 count as gold."""
    gold = qrels.select("qid", "doc_id").distinct()
    got = retrieved.select("qid", "doc_id").distinct()
    n_gold = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    n_got = got.groupBy("qid").agg(F.count(F.lit(1)).alias("n_got"))
    n_both = gold.join(got, ["qid", "doc_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("n_both"))
    d = predictions.select("qid").join(n_gold, "qid", "left").join(n_got, "qid", "left").join(n_both, "qid", "left")
    category = F.when(F.col("n_gold").isNull(), "no_gold_standard").when(F.col("n_got").isNull(), "no_retrieval").when(F.col("n_both").isNull(), "retriever_miss").otherwise("reader_issue")
    return d.select("qid", category.alias("category"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("n_got", F.lit(0)).alias("n_got"), F.coalesce("n_both", F.lit(0)).alias("n_both"))


def category_counts(categories: DataFrame) -> DataFrame:
    """category, n, percent of all predictions."""
    c = categories.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = categories.agg(F.count(F.lit(1)).alias("_all"))
    return c.join(F.broadcast(total)).select("category", "n", F.round(100 * F.col("n") / F.col("_all"), 6).alias("percent"))


def retrieval_means(categories: DataFrame) -> DataFrame:
    """Mean recall and precision over queries that have gold and retrieved documents."""
    own = categories.filter((F.col("n_gold") > 0) & (F.col("n_got") > 0))
    return own.agg(
        F.round(F.avg(F.col("n_both") / F.col("n_gold")), 6).alias("avg_recall"), F.round(F.avg(F.col("n_both") / F.col("n_got")), 6).alias("avg_precision"), F.count(F.lit(1)).alias("n_queries")
    )


def rank_agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """qid, share of b's k best that a has too. Both: qid, doc_id, rank."""
    both = a.filter(F.col("rank") <= k).select("qid", "doc_id").join(b.filter(F.col("rank") <= k).select("qid", "doc_id"), ["qid", "doc_id"])
    n = both.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return a.select("qid").distinct().join(n, "qid", "left").select("qid", F.round(F.coalesce("n", F.lit(0)) / k, 6).alias("overlap"))


def rank_correlation(a: DataFrame, b: DataFrame, least: int = 10) -> DataFrame:
    """qid, Spearman correlation of the places of documents that both rankings have, if more than `least`."""
    j = a.select("qid", "doc_id", F.col("rank").alias("ra")).join(b.select("qid", "doc_id", F.col("rank").alias("rb")), ["qid", "doc_id"])
    c = j.groupBy("qid").agg(F.corr("ra", "rb").alias("r"), F.count(F.lit(1)).alias("n_common")).filter(F.col("n_common") > least)
    return c.select("qid", "n_common", F.round("r", 6).alias("spearman"))
