"""Retrievers and readers by name; both can be extended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells as X
from ..operators import contexts as C
from ..operators import scoring as S
from ..operators import vectors as V

#: A retriever takes documents (doc_id, text), queries (qid, text) and k; it returns qid, doc_id, score, rank.
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]
#: A reader takes queries with contexts (qid, query, contexts); it returns qid, answer.
Reader = Callable[[DataFrame], DataFrame]


def _bm25(**p) -> Retriever:
    return lambda docs, queries, k: S.bm25(docs, queries, k, **p)


def _tfidf(**_) -> Retriever:
    return S.tfidf


def _flat_bm25(**p) -> Retriever:
    return _bm25(**({"k1": 1000.0, "b": 0.0} | p))


def _okapi(**p) -> Retriever:
    return lambda docs, queries, k: S.bm25_okapi(docs, queries, k, **p)


def _vectors(quantised: bool = True, **_) -> Retriever:
    """docs and queries carry an embedding instead of text."""

    def run(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        q, scale = V.quantise_symmetric(F.col("embedding"))
        if not quantised:
            q, scale = F.col("embedding"), F.lit(127.0)
        d = docs.select("doc_id", q.alias("v"), (scale / 127).alias("scale"))
        return X.search(d, queries.select("qid", q.alias("v"), (scale / 127).alias("scale")), k)

    return run


def _hybrid(sparse_weight: float = 0.3, dense_weight: float = 0.7, **_) -> Retriever:
    """An extension: weighted sum of the reciprocal ranks of BM25 and vectors; docs carry both columns."""

    def run(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        parts = [(S.bm25(docs, queries, 5 * k), sparse_weight), (_vectors()(docs, queries, 5 * k), dense_weight)]
        both = [r.select("qid", "doc_id", (F.lit(w) / F.col("rank")).alias("w")) for r, w in parts]
        s = both[0].unionByName(both[1]).groupBy("qid", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
        return S.top_k(s, k, "qid")

    return run


class Registry:
    """Names to factories; unknown names raise ValueError."""

    def __init__(self, kind: str, **known: Callable):
        self.kind, self._known = kind, dict(known)

    def register(self, name: str, factory: Callable) -> None:
        self._known[name] = factory

    def available(self) -> list[str]:
        return sorted(self._known)

    def create(self, name: str, **params):
        found = self._known.get(name) or self._known.get(name.lower())
        if found is None:
            raise ValueError(f"Unknown {self.kind}: {name}; there are {', '.join(self.available())}")
        return found(**params)


retrievers = Registry(
    "retriever", bm25=_bm25, bm25_retriever=_bm25, bm25_custom=_bm25, bm25_flat=_flat_bm25, okapi=_okapi, tfidf=_tfidf, dpr=_vectors, contriever=_vectors, splade=_vectors, hybrid=_hybrid
)
readers = Registry(
    "reader",
    extractive=lambda longest=500, **_: lambda q: C.extractive(q, longest),
    extractive_weighted=lambda longest=200, **_: lambda q: C.extractive_weighted(q, longest),
    first_context=lambda longest=200, **_: lambda q: C.first_context(q, longest),
    generative=lambda longest=500, **_: lambda q: C.generative(q, longest),
    generative_smart=lambda longest=800, **_: lambda q: C.generative_smart(q, longest),
    generative_simple=lambda longest=800, **_: lambda q: C.generative_simple(q, longest),
    llm=lambda model="model", **_: lambda q: C.placeholder(q, model),
)
