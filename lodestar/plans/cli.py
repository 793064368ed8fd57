"""Command lines.

run CONFIG.json                   experiments of a configuration
ablate CONFIG.json GRID.json      experiments of a grid: dotted path to list of values
efficiency DATASET [RETRIEVER]    query latency, build time, build time by number of documents
baseline DATASET                  BM25 over title and text, metrics at 10 and 100
bench [SUITE ...]                 benchmark suites, as a table
integration OUT                   all suites, graded, with recommendations, as Markdown and CSV under OUT
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import titled
from ..operators import index as I
from ..operators import metrics as M
from ..operators import scoring as S
from ..runtime import materialise
from ..sources import sinks
from . import experiment as E
from . import suite
from .registry import retrievers


def ablate(spark: SparkSession, base: dict, grid: dict[str, list]) -> list[dict]:
    """The outcome of each combination, by name."""
    return [{"name": name} | E.run_all(spark, config) for name, config in E.ablations(base, grid)]


def efficiency(spark: SparkSession, path: str, retriever: str = "bm25", queries: int = 20) -> dict:
    """Seconds of building an index, of the first `queries` queries each asked alone, and of growing builds."""
    corpus, asked, _ = E.dataset(spark, path)
    corpus = materialise(corpus, "corpus")
    n = corpus.count()
    build = E.measured(lambda: I.build(corpus).docs.write.format("noop").mode("overwrite").save())
    search = retrievers.create(retriever)
    some = [r.qid for r in asked.orderBy("qid").limit(queries).collect()]
    each = [E.measured(lambda q=q: search(corpus, asked.filter(F.col("qid") == q), 10).collect()) for q in some]
    sizes = tuple(x for x in (100, 500, 1000, 5000) if x < n) + (n,)
    return {"documents": n, "build": build, "queries": each, "scaling": E.scaling(lambda d: I.build(d).docs, corpus, sizes)}


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """k and the means of nDCG, MAP, recall and precision of BM25 over title and text."""
    corpus, asked, rel = E.dataset(spark, path)
    if rel is None:
        raise ValueError(f"{path} has no judgements")
    docs = materialise(corpus.select("doc_id", titled(F.col("title"), F.col("text")).alias("text")), "titled")
    run = materialise(S.bm25_okapi(docs, asked, 100), "run")
    out = None
    for k in (10, 100):
        m = M.ranking_metrics(run, rel, k).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "ap", "recall", "precision")])
        m = m.select(F.lit(k).alias("k"), "*")
        out = m if out is None else out.unionByName(m)
    return out.withColumnRenamed("ap", "map")


def bench(spark: SparkSession, names: list[str]) -> DataFrame:
    """suite, seconds, whether it ran, its figures as JSON."""
    own = [s for s in suite.built_in() if not names or s.name in names]
    rows = [(r["suite"], r["category"], r["seconds"], r["error"], json.dumps(r["figures"])) for r in suite.run_suites(spark, own)]
    return spark.createDataFrame(rows, "suite string, category string, seconds double, error string, figures string")


def integration(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Runs all suites; writes checks as CSV and the report as Markdown. Returns (grade, recommendations)."""
    results = suite.run_suites(spark, suite.built_in())
    grade, advice = suite.assessment(spark, results)
    own = suite.checks(spark, results)
    sinks.csv(own, f"{out}/checks")
    text = "\n".join(sinks.markdown(d, title) for d, title in ((grade, "Grade"), (own, "Checks"), (advice, "Recommendations")))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return grade, advice


def main(args: list[str]) -> int:
    from ..runtime import session

    known = {"run": 1, "ablate": 2, "efficiency": 1, "baseline": 1, "bench": 0, "integration": 1}
    if not args or args[0] not in known or len(args) - 1 < known[args[0]]:
        print(__doc__)
        return 2
    spark, (command, *rest) = session(args[0]), args

    def read(path: str) -> dict:
        with open(path) as f:
            return json.load(f)

    if command == "run":
        print(json.dumps(E.run_all(spark, read(rest[0])), indent=1))
    elif command == "ablate":
        print(json.dumps(ablate(spark, read(rest[0]), read(rest[1])), indent=1))
    elif command == "efficiency":
        print(json.dumps(efficiency(spark, *rest[:2]), indent=1))
    elif command == "baseline":
        print(sinks.markdown(baseline(spark, rest[0]), "Baseline"))
    elif command == "bench":
        print(sinks.markdown(bench(spark, rest), "Suites"))
    else:
        for d, title in zip(integration(spark, rest[0]), ("Grade", "Recommendations"), strict=True):
            print(sinks.markdown(d, title))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
