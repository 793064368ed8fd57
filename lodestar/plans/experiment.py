"""Experiments: a retriever and a reader over a data set, by configuration; and grids of them.

The configuration is control plane: dictionaries of output_dir and experiments,
each with name, dataset, retriever {type, params} and reader {type, params}.
"""

from __future__ import annotations

import copy
import itertools
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contexts as C
from ..operators.index import build as build_index
from ..runtime import materialise
from ..sources import text_files as L
from .registry import readers, retrievers


def dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(corpus, queries, judgements or None) of a folder with corpus.jsonl, queries.jsonl, qrels/test.tsv."""
    corpus = L.load_corpus(L.lines(spark, f"{path}/corpus.jsonl"))
    queries = L.load_queries(L.lines(spark, f"{path}/queries.jsonl"))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/qrels/test.tsv")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return corpus, queries, L.load_qrels(L.lines(spark, f"{path}/qrels/test.tsv")) if there else None


def predict(corpus: DataFrame, queries: DataFrame, retriever: dict, reader: dict, top_k: int = 50) -> DataFrame:
    """qid, query, answer, contexts, retriever_scores of every query with text; blank queries fall out."""
    asked = queries.filter(F.length(F.trim("text")) > 0)
    run = retrievers.create(retriever["type"], **retriever.get("params", {}))(corpus, asked, top_k)
    run = materialise(run, "run")
    ctx = materialise(C.contexts(run, corpus), "contexts")
    answers = readers.create(reader["type"], **reader.get("params", {}))(C.gathered(asked, C.dedupe_by_prefix(ctx)))
    stored = ctx.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("docid"), F.col("stored").alias("text")))).alias("c"))
    stored = stored.select("qid", F.transform("c", lambda x: F.struct(x["docid"].alias("docid"), x["text"].alias("text"))).alias("contexts"))
    scores = run.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), "score"))).alias("retriever_scores"))
    d = asked.select("qid", F.col("text").alias("query")).join(answers, "qid").join(stored, "qid", "left").join(scores, "qid", "left")
    return d


def run_experiment(spark: SparkSession, config: dict, out: str) -> dict:
    """Write predictions to out as JSON; returns the summary. Errors become part of the summary."""
    began = time.time()
    try:
        corpus, queries, _ = dataset(spark, config["dataset"])
        corpus = materialise(corpus, "corpus")
        p = config["retriever"].get("params", {})
        settings = {**config["retriever"], "params": {k: v for k, v in p.items() if k != "top_k"}}
        predict(corpus, queries, settings, config["reader"], p.get("top_k", 50)).write.mode("overwrite").json(out)
        n, took = spark.read.json(out).count(), time.time() - began
        return {"name": config["name"], "queries": n, "seconds": round(took, 3), "queries_per_second": round(n / took, 3)}
    except Exception as e:
        return {"name": config.get("name"), "error": f"{type(e).__name__}: {str(e)[:500]}"}


def run_all(spark: SparkSession, config: dict) -> dict:
    """All experiments of a configuration, one failing without the others."""
    results = [run_experiment(spark, x, f"{config['output_dir']}/{x['name']}") for x in config["experiments"]]
    return {"results": results, "succeeded": sum("error" not in r for r in results), "failed": sum("error" in r for r in results)}


def updated(base: dict, over: dict) -> dict:
    """base with over's leaves; lists are merged element by element."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = updated(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            pairs = itertools.zip_longest(out[k], v)
            out[k] = [a if b is None else updated(a, b) if isinstance(a, dict) and isinstance(b, dict) else b for a, b in pairs]
        else:
            out[k] = copy.deepcopy(v)
    return out


def ablations(base: dict, grid: dict[str, list]) -> Iterator[tuple[str, dict]]:
    """(name, configuration) of each combination; keys of grid are dotted paths into the first experiment."""
    for values in itertools.product(*grid.values()):
        over: dict = {}
        for path, v in zip(grid, values, strict=True):
            at = over
            *way, leaf = path.split(".")
            for w in way:
                at = at.setdefault(w, {})
            at[leaf] = v
        name = ",".join(f"{k}={v}" for k, v in zip(grid, values, strict=True))
        yield name, updated(base, {"experiments": [over | {"name": name}]})


def measured(f: Callable, *args) -> dict:
    """Seconds of a call, or its error."""
    began = time.time()
    try:
        f(*args)
        return {"seconds": round(time.time() - began, 6), "error": None}
    except Exception as e:
        return {"seconds": round(time.time() - began, 6), "error": f"{type(e).__name__}: {e}"}


def scaling(build: Callable[[DataFrame], DataFrame], docs: DataFrame, sizes: tuple[int, ...]) -> list[dict]:
    """Time to build over the first n documents by id, for each n."""
    out = []
    for n in sizes:
        own = docs.orderBy("doc_id").limit(n)
        out.append({"n": n} | measured(lambda d=own: build(d).write.format("noop").mode("overwrite").save()))
    return out


def index_sizes(docs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """n, vocabulary, postings of the index of the first n documents by id, for each n and for all."""
    total, out = docs.count(), None
    for n in sorted({*[x for x in sizes if x < total], total}):
        own = build_index(docs if n == total else docs.orderBy("doc_id").limit(n))
        part = own.terms.agg(F.lit(n).cast("long").alias("n"), F.count(F.lit(1)).alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
        out = part if out is None else out.unionByName(part)
    return out


def main(path: str) -> None:
    """python -m lodestar.plans.experiment CONFIG.json"""
    from ..runtime import session

    with open(path) as f:
        print(json.dumps(run_all(session("experiment"), json.load(f)), indent=1))


if __name__ == "__main__":
    import sys

    main(sys.argv[1])
