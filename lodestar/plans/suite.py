"""Benchmark suites: set up, run, clean up; and the built-in ones over synthetic data."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitoring as N
from ..operators import scoring as S
from ..operators import segments as G
from ..operators import vectors as V
from ..sources import synthetic

#: What to do about a failed check.
ADVICE = {
    ("retrieval", "correct"): "Retrieval: compare scores with the plain formula, word by word.",
    ("retrieval", "fast"): "Retrieval: keep the index, and ask more queries at a time.",
    ("vectors", "correct"): "Vectors: widen the quantisation range, or search in floats.",
    ("vectors", "fast"): "Vectors: quantise once, and keep the quantised table.",
    ("topk", "correct"): "Top-k: raise the accuracy of the percentile.",
    ("topk", "fast"): "Top-k: cut by a threshold before sorting.",
}


class Suite(ABC):
    """A benchmark with a name and a category. run() returns figures; `passed` names the checks that held."""

    name, category = "suite", "general"

    def setup(self, spark: SparkSession) -> None:
        """Whatever must be there before the clock starts."""

    @abstractmethod
    def run(self, spark: SparkSession) -> dict:
        """The figures, and under `checks` a dictionary of check and whether it held."""

    def cleanup(self, spark: SparkSession) -> None:
        """Called after run() and after a failure."""


def run_suite(spark: SparkSession, suite: Suite) -> dict:
    """suite, category, seconds, figures or error. Cleaning up is part of every run, failed ones too."""
    out = {"suite": suite.name, "category": suite.category, "seconds": 0.0, "figures": {}, "error": None}
    try:
        suite.setup(spark)
        began = time.time()
        out["figures"] = suite.run(spark)
        out["seconds"] = round(time.time() - began, 6)
    except Exception as e:
        out["error"] = f"{type(e).__name__}: {str(e)[:500]}"
    finally:
        try:
            suite.cleanup(spark)
        except Exception as e:
            out["error"] = out["error"] or f"{type(e).__name__}: {str(e)[:500]}"
    return out


def run_suites(spark: SparkSession, suites: Iterable[Suite]) -> list[dict]:
    """All of them, one failing without the others."""
    return [run_suite(spark, s) for s in suites]


class _Timed(Suite):
    """A suite of one timed action over data made at setup, and checks of its result."""

    def __init__(self, name: str, make: Callable, act: Callable, check: Callable, target: float):
        self.name, self.category, self.make, self.act, self.check, self.target = name, "operators", make, act, check, target

    def setup(self, spark: SparkSession) -> None:
        self.data = self.make(spark)

    def run(self, spark: SparkSession) -> dict:
        began = time.time()
        rows = self.act(self.data).collect()
        took = time.time() - began
        return {"seconds": round(took, 6), "rows": len(rows), "checks": {"correct": bool(self.check(self.data, rows)), "fast": took <= self.target}}

    def cleanup(self, spark: SparkSession) -> None:
        for d in getattr(self, "data", ()):
            d.unpersist()
        self.data = ()


def _best_first(data, rows) -> bool:
    return all(r.score > 0 for r in rows) and all(r.rank <= 10 for r in rows)


def built_in() -> list[Suite]:
    def texts(spark):
        docs, queries = synthetic.zipf_corpus(spark, 10_000).cache(), synthetic.zipf_queries(spark, 100).cache()
        G.kept(docs)
        return docs, queries

    def embedded(spark):
        q, scale = V.quantise_symmetric(F.col("embedding"))
        v = synthetic.clustered_vectors(spark, 2000).select(F.col("vec_id").alias("doc_id"), q.alias("v"), (scale / 127).alias("scale"))
        return (v.cache(),)

    def near_itself(data, rows):
        return sum(r.doc_id == r.qid for r in rows if r.rank == 1) >= 45

    return [
        _Timed("retrieval", texts, lambda d: S.bm25(*d), _best_first, 10.0),
        _Timed("vectors", embedded, lambda d: V.top_by_dot(d[0], d[0].filter("doc_id < 50").withColumnRenamed("doc_id", "qid"), 10), near_itself, 10.0),
        _Timed("topk", lambda spark: (synthetic.scores(spark, 100_000).cache(),), lambda d: S.approx_top_k(d[0], 50), lambda d, rows: len(rows) == 50, 10.0),
    ]


def checks(spark: SparkSession, results: list[dict]) -> DataFrame:
    """component, check, passed of all results; a result without figures fails all its checks."""
    rows = [(r["suite"], c, r["error"] is None and r["figures"].get("checks", {}).get(c, False)) for r in results for c in ("correct", "fast")]
    return spark.createDataFrame(rows, "component string, check string, passed boolean")


def assessment(spark: SparkSession, results: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(score and grade of the whole, advice)."""
    c = checks(spark, results)
    return N.overall_grades(c), N.recommendations(c, ADVICE)
