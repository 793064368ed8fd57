"""Sparse scoring: BM25 in its variants, TF-IDF, and top-k runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import tokens, ws_tokens
from ..runtime import BROADCAST_ROWS, materialise
from .index import Index, Range, askers, block_rows, bucket_of, by_range, idf_bm25, idf_tfidf, places_of, ranges, term_counts
from .segments import kept

#: Pairs of a query and a word that are sent to the index at once, and postings that a task adds up at a time.
ASKED = 200_000
_CELLS = 1 << 20
#: Share of the sum of a query's bounds that the words left to the second round have, at most.
LATER = 0.1
#: Words that are listed in the scan's filter; more are only joined.
_LISTED = 200
#: Least raw score that does not round to 0, and what sums and rounding may differ by.
HALF, _NEAR = 5e-7, 2e-6

#: Largest accuracy asked of percentile_approx.
MOST_ACCURATE = 1 << 20


def bm25_weight(tf: Column, dl: Column, avgdl: Column, idf: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def top_k(scores: DataFrame, k: int, *by: str, score: str = "score", id_: str = "doc_id") -> DataFrame:
    """The k best rows of each `by`, ties to the smaller id, with a rank from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), id_)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def approx_top_k(scores: DataFrame, k: int, score: str = "score", id_: str = "id", accuracy: int = 1000) -> DataFrame:
    """The k best rows of all: those above a threshold from an approximate percentile, then a bounded sort.

    accuracy is the least one; it follows n / k, as the percentile's error must stay below the share that is kept,
    up to MOST_ACCURATE, as the summary grows with it. Where fewer than k rows pass, all rows are sorted.
    """
    n = scores.count()
    if n > 10 * k:
        share = 1 - 2 * k / n
        accuracy = min(max(accuracy, math.ceil(10 * n / k)), MOST_ACCURATE)
        cut = scores.agg(F.percentile_approx(score, F.lit(share), F.lit(accuracy)).alias("_cut"))
        above = scores.join(F.broadcast(cut), F.col(score) >= F.col("_cut")).drop("_cut")
        if above.count() >= k:
            scores = above
    return scores.orderBy(F.desc(score), id_).limit(k)


@dataclass
class _Asked:
    """A block of queries: their known words, each with its idf and the queries that have it.

    first: whether a query's word is read in the first round. The others are those of least bound, and their scores lie
    between low and high for each query, whatever the document.
    """

    words: list
    idf: np.ndarray
    cut: np.ndarray
    query: np.ndarray
    times: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray
    avgdl: float
    everywhere: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  #: queries that the second round has in all ranges


def _asked(own: pa.Table, n_queries: int, avgdl: float, weigh) -> _Asked:
    """own: place, term, qtf, idf, most_tf, least_dl of a block."""
    words = pc.unique(own["term"])
    term = pc.index_in(own["term"], value_set=words).to_numpy().astype(np.int64)
    order = np.argsort(term, kind="stable")
    term, query = term[order], own["place"].to_numpy()[order]
    times, idf = own["qtf"].to_numpy()[order].astype(float), own["idf"].to_numpy()[order]
    bound = times * weigh(own["most_tf"].to_numpy()[order].astype(float), own["least_dl"].to_numpy()[order].astype(float), avgdl, idf)
    best = np.maximum(bound, 0)
    total = np.bincount(query, best, n_queries)
    by = np.lexsort((best, query))
    sums = np.cumsum(best[by])
    before = np.concatenate([[0], sums])[np.searchsorted(query[by], np.arange(n_queries))]
    first = np.ones(len(query), bool)
    first[by] = sums - before[query[by]] > LATER * total[query[by]]
    weights = np.zeros(len(words))
    weights[term] = idf
    low, high = (np.bincount(query[~first], x[~first], n_queries) for x in (np.minimum(bound, 0), best))
    return _Asked(words.to_pylist(), weights, np.searchsorted(term, np.arange(len(words) + 1)), query, times, first, low, high, avgdl)


def _summed(q: _Asked, weigh, of: Range, only: np.ndarray | None, part: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, places and scores in a range, of some queries at a time; only: these queries, part: these of the queries' words."""
    block, place, tf, dl = places_of(of)
    word = of.blocks.column("word").to_numpy()
    many = np.bincount(block, minlength=len(word))
    at = np.concatenate([[0], np.cumsum(many)])
    weight = weigh(tf.astype(float), dl.astype(float), q.avgdl, q.idf[word][block])
    asked = q.cut[word + 1] - q.cut[word]
    entry = np.arange(asked.sum()) - np.repeat(np.cumsum(asked) - asked, asked) + np.repeat(q.cut[word], asked)
    own = np.repeat(np.arange(len(word)), asked)
    stay = np.ones(len(entry), bool) if part is None else part[entry]
    if only is not None:
        stay &= np.isin(q.query[entry], only)
    entry, own = entry[stay], own[stay]
    order = np.argsort(q.query[entry], kind="stable")
    entry, own = entry[order], own[order]
    query, ends = q.query[entry], np.cumsum(many[own])
    i = 0
    while i < len(entry):
        z = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CELLS, "right")))
        z = int(np.searchsorted(query, query[z - 1], "right"))  # a query's words stay together
        m = many[own[i:z]]
        posting = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - at[own[i:z]], m)
        width = int(place.max(initial=0)) + 1
        key = np.repeat(query[i:z] - query[i], m) * width + place[posting]
        score = np.repeat(q.times[entry[i:z]], m) * weight[posting]
        cells = int(query[z - 1] - query[i] + 1) * width
        if cells <= 4 * len(key):
            score, found = np.bincount(key, score, cells), np.bincount(key, minlength=cells)
            key = np.flatnonzero(found)
            score = score[key]
        else:
            key, inverse = np.unique(key, return_inverse=True)
            score = np.bincount(inverse, score, len(key))
        yield query[i] + key // width, key % width, score
        i = z


def _best_of(query: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each query are, ties to the smaller place, best first."""
    order = np.lexsort((place, -np.round(score, 6), query))
    query = query[order]
    new = np.ones(len(query), bool)
    new[1:] = query[1:] != query[:-1]
    start = np.flatnonzero(new)
    return order[np.arange(len(query)) - np.repeat(start, np.diff([*start, len(query)])) < k]


class _Least:
    """The k-th best score that a task has seen of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.held = k, np.full((n, k), -np.inf)

    def of(self, query: np.ndarray) -> np.ndarray:
        return self.held[query, 0]

    def add(self, query: np.ndarray, score: np.ndarray) -> None:
        """k scores of a query at most, those of a query together."""
        own, start = np.unique(query, return_index=True)
        both = np.full((len(own), 2 * self.k), -np.inf)
        both[:, : self.k] = self.held[own]
        both[np.searchsorted(own, query), self.k + np.arange(len(query)) - np.repeat(start, np.diff([*start, len(query)]))] = score
        self.held[own] = np.partition(both, self.k, axis=1)[:, self.k :]  # the least of them first


def _first_round(sent, weigh, k: int):
    """Blocks of the first words -> (place, range, raw): of each query and range the k best sums that may still count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: _Asked = sent.value
        least = _Least(len(q.low), k)
        for own in ranges(batches):
            if not own.blocks.num_rows:
                continue
            for query, place, score in _summed(q, weigh, own, None, q.first):
                possible = (score + q.high[query] >= HALF) & (score + q.high[query] >= least.of(query) + q.low[query] - _NEAR)
                query, place, score = query[possible], place[possible], score[possible]
                best = _best_of(query, place, score, k)
                query, score = query[best], score[best]
                if len(query):
                    least.add(query, score)
                    cols = [pa.array(query), pa.array(np.full(len(query), own.number)), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(cols, names=["place", "range", "raw"])

    return run


def _second_round(sent, weigh, k: int):
    """Blocks of all words in the ranges that are left, each range led by its queries -> (place, range, at, raw): of each query
    and range the k best documents, by their place in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: _Asked = sent.value
        least = _Least(len(q.low), k)
        for own in ranges(batches):
            asked = np.union1d(own.queries, q.everywhere)
            if not own.blocks.num_rows or not len(asked):
                continue
            for query, place, score in _summed(q, weigh, own, asked, None):
                possible = (score >= HALF) & (score >= least.of(query) - _NEAR)
                query, place, score = query[possible], place[possible], score[possible]
                best = _best_of(query, place, score, k)
                query, place, score = query[best], place[best], score[best]
                if len(query):
                    least.add(query, score)
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.full(len(query), own.number)), pa.array(place), pa.array(score)], names=["place", "range", "at", "raw"])

    return run


def _block_hits(index: Index, own: pa.Table, k: int, avgdl: float, weigh) -> tuple[DataFrame, DataFrame] | None:
    """(place, doc_id, raw) of a block of queries, and (place, qid); None where nothing can score. own: qid, term, qtf, most_tf, least_dl, idf, bucket."""
    spark = index.parts.sparkSession
    qids = pc.unique(own["qid"])
    own = own.append_column("place", pc.cast(pc.index_in(own["qid"], value_set=qids), pa.int64()))
    asked = _asked(own, len(qids), avgdl, weigh)
    sent = spark.sparkContext.broadcast(asked)
    entry_word = np.repeat(np.arange(len(asked.words)), np.diff(asked.cut))
    early = np.bincount(entry_word, asked.first, len(asked.words)) > 0
    bucket = dict(zip(own["term"].to_pylist(), own["bucket"].to_pylist(), strict=True))
    words = pa.table({"_term": asked.words, "word": np.arange(len(asked.words)), "early": early, "_b": pa.array([bucket[w] for w in asked.words], pa.int32())})

    def blocks_of(which: pa.Table) -> DataFrame:
        """The blocks of these words, from their buckets."""
        listed = F.broadcast(spark.createDataFrame(which.select(["_term", "word"])))
        found = index.blocks.filter(F.col("bucket").isin(pc.unique(which["_b"]).to_pylist()))
        if which.num_rows <= _LISTED:
            found = found.filter(F.col("term").isin(which["_term"].to_pylist()))
        return found.join(listed, F.col("term") == F.col("_term"))

    if not early.any() and not (asked.high > HALF / 2).any():
        return None
    kinds = "place long, range long, raw double"
    early_rows = by_range([*index.lost_places, block_rows(blocks_of(words.filter(words["early"])), "word")])
    sums = materialise(early_rows.mapInArrow(_first_round(sent, weigh, k), kinds), "first-sums")
    w = Window.partitionBy("place").orderBy(F.desc("raw"))
    least = np.full(len(qids), HALF)
    for r in sums.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == k).collect():  # one a query of the block
        least[r.place] = max(HALF, r.raw + asked.low[r.place])
    open_ = (asked.high >= least - _NEAR) & (asked.high > HALF / 2)  # documents without any of the first words may be among the best
    limits = spark.createDataFrame(pa.table({"_p": np.arange(len(qids)), "_need": least - asked.high - _NEAR, "_open": open_}))
    left = sums.groupBy("place", "range").agg(F.max("raw").alias("raw")).join(F.broadcast(limits), F.col("place") == F.col("_p"))
    left = materialise(left.filter((F.col("raw") >= F.col("_need")) & ~F.col("_open")).select("range", "place"), "ranges-left")
    listed = left.select(F.col("range").alias("_r")).distinct()
    listed = F.broadcast(listed) if left.count() <= BROADCAST_ROWS else listed
    blocks, docs = blocks_of(words), index.docs
    if open_.any():
        wide = np.unique(entry_word[open_[asked.query]])
        wide = F.broadcast(spark.createDataFrame(pa.table({"_w": wide})))
        blocks = blocks.join(wide, F.col("word") == F.col("_w"), "left_semi").unionByName(
            blocks.join(wide, F.col("word") == F.col("_w"), "left_anti").join(listed, F.col("range") == F.col("_r"), "left_semi")
        )
        sent = spark.sparkContext.broadcast(replace(asked, everywhere=np.flatnonzero(open_)))
    else:
        docs, blocks = (x.join(listed, F.col("range") == F.col("_r"), "left_semi") for x in (docs, blocks))
    rows = by_range([*index.lost_places, askers(left), block_rows(blocks, "word")])
    hits = rows.mapInArrow(_second_round(sent, weigh, k), "place long, range long, at long, raw double")
    # within a range places follow ids
    hits = hits.join(docs.select("range", "doc_ids"), "range").select("place", F.get("doc_ids", F.col("at").cast("int")).alias("doc_id"), "raw")
    return hits, spark.createDataFrame(pa.table({"_place": np.arange(len(qids)), "qid": qids}))


def _run(index: Index, queries: DataFrame, k: int, weigh, idf, tokenise=tokens) -> DataFrame:
    """qid, doc_id, score, rank: the sum of a query's word scores for each document, positive ones, k best.

    Queries go to the index in blocks of ASKED words; only the buckets of their words are read. In a first round all but the
    words of least bound are read, and their sums give each query a score that its k-th best cannot be below. In the second round
    the other words too are read, in the ranges where a sum and the others' bounds reach that score; where those
    bounds alone reach it, in all ranges. So every document that can be among the k best is scored in full, and others are not.
    weigh(tf, dl, avgdl, idf) is a word's score in a document, larger for more occurrences and fewer words;
    idf(n, df) a column.
    """
    q = term_counts(queries, "qid", out="qtf", tokenise=tokenise)
    n, avgdl = index.stats.first()
    known = q.join(index.terms, "term").select("qid", "term", "qtf", "most_tf", "least_dl", idf(F.lit(n), F.col("df")).alias("idf"), bucket_of(F.col("term")).alias("bucket"))
    few = known.limit(ASKED + 1).toArrow()
    blocks = 1
    if few.num_rows > ASKED:
        q = materialise(known, "asked")
        blocks = math.ceil(q.count() / ASKED)
    out = None
    for i in range(blocks):
        own = few if blocks == 1 else q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow()
        found = _block_hits(index, own.combine_chunks(), k, float(avgdl or 0.0), weigh) if own.num_rows else None
        if found is not None:
            hits, places = found
            part = hits.join(F.broadcast(places), F.col("place") == F.col("_place")).select("qid", "doc_id", F.round("raw", 6).alias("score"))
            part = part if blocks == 1 else materialise(top_k(part.filter("score > 0"), k, "qid").drop("rank"), "hits")
            out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = StructType([queries.schema["qid"], StructField("doc_id", index.parts.schema["doc_ids"].dataType.elementType)]).add("score", "double")
        out = queries.sparkSession.createDataFrame([], kinds)
    return top_k(out.filter("score > 0"), k, "qid")


def _index(docs: DataFrame | Index, tokenise=tokens) -> Index:
    return docs if isinstance(docs, Index) else kept(docs, tokenise)


def bm25(docs: DataFrame | Index, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """docs (doc_id, text), or an index of them; queries (qid, text) -> qid, doc_id, score, rank.

    Repeated query words weigh by their count, unknown words nothing; a query
    without known words has no rows. The index of docs is kept for later calls.
    """

    def weigh(tf, dl, avgdl, idf):
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    return _run(_index(docs), queries, k, weigh, idf_bm25)


def tfidf(docs: DataFrame | Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Raw counts times ln(n / (df + 1)); lengths play no part."""

    def weigh(tf, dl, avgdl, idf):
        return tf * idf

    return _run(_index(docs), queries, k, weigh, idf_tfidf)


def bm25_okapi(docs: DataFrame | Index, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """White-space words; a negative idf gives way to epsilon times the mean idf of the whole vocabulary."""
    index = _index(docs, ws_tokens)
    n = index.stats.first().n
    mean = index.terms.agg(F.avg(idf_bm25(F.lit(n), F.col("df")))).first()[0]

    def idf(n: Column, df: Column) -> Column:
        own = idf_bm25(n, df)
        return F.when(own < 0, F.lit(epsilon) * F.lit(mean)).otherwise(own)

    def weigh(tf, dl, avgdl, idf):
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    return _run(index, queries, k, weigh, idf, ws_tokens)


def term_weights(docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, term, weight of every posting."""
    i = kept(docs)
    m = i.postings.join(i.terms, "term").join(F.broadcast(i.stats))
    w = bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), idf_bm25(F.col("n"), F.col("df")), k1, b)
    return m.select("doc_id", "term", F.round(w, 6).alias("weight"))


def known_terms(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, term, qtf of the query words that some document has."""
    q = term_counts(queries, "qid", out="qtf")
    return q.join(kept(docs).terms, "term", "left_semi").select("qid", "term", "qtf")


def empty_queries(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, n_known_terms, is_empty of every query, also of those that match nothing."""
    known = known_terms(docs, queries).groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    return queries.select("qid").join(known, "qid", "left").select("qid", F.coalesce("_n", F.lit(0)).alias("n_known_terms"), F.col("_n").isNull().alias("is_empty"))
