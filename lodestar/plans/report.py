"""Command-line reports: evaluation of generated answers, error analysis, data-set validation."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import docstore as D
from ..operators import metrics as M
from ..sources import one_pass as P
from ..sources import text_files as L


def means(pairs: DataFrame, *key: str) -> DataFrame:
    """One row: means of ROUGE-1, 2 and L, BLEU and faithfulness, and the number of pairs.

    pairs: key, pred, ref, contexts, an array of texts.
    """
    score, n = M.faithfulness(F.col("pred"), F.col("contexts"))
    out = pairs.agg(F.round(F.avg(score), 6).alias("faithfulness"), F.round(F.avg(n), 6).alias("supporting"), F.count(F.lit(1)).alias("n"))
    p = pairs.select(*key, "pred", "ref")
    for name, m, c in (("rouge1", M.rouge_n(p, 1, *key), "f1"), ("rouge2", M.rouge_n(p, 2, *key), "f1"), ("rougeL", M.rouge_l(p, *key), "f1"), ("bleu", M.bleu(p, *key), "bleu")):
        out = out.crossJoin(m.agg(F.round(F.avg(c), 6).alias(name)))
    return out


def evaluate(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """One row of means. predictions: qid, answer, contexts; references: qid, answer. Empty sides are skipped."""
    ref = references.select("qid", F.col("answer").alias("ref")).filter(F.length("ref") > 0)
    p = predictions.select("qid", F.col("answer").alias("pred"), "contexts").filter(F.length("pred") > 0).join(ref, "qid")
    return means(p.withColumn("contexts", F.transform("contexts", lambda c: c["text"])), "qid")


def errors(predictions: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts of error categories, mean recall and precision)."""
    got = predictions.select("qid", F.explode("contexts").alias("c")).select("qid", F.col("c.docid").alias("doc_id"))
    c = M.error_categories(predictions, got, qrels)
    return M.category_counts(c), M.retrieval_means(c)


def validate(spark: SparkSession, path: str) -> tuple[bool, DataFrame, DataFrame | None]:
    """(valid, errors with their file, statistics or None). Errors of corpus or queries end the validation. Each file is read once."""
    own = {"corpus": P.scan(spark, f"{path}/corpus.jsonl"), "queries": P.scan(spark, f"{path}/queries.jsonl", L.QUERY_IDS, L.QUERY_TEXTS, ())}
    if any(x.malformed or x.invalid for x in own.values()):
        parts = [x.errors.select(F.lit(name).alias("file"), "ord", "error") for name, x in own.items()]
        return False, parts[0].unionByName(parts[1]), None
    docs, queries = P.corpus(own["corpus"]), P.queries(own["queries"])
    rows = P.lines(spark, f"{path}/qrels/test.tsv").filter("line <> ''")
    found = L.validate_qrels(rows, queries, docs).select(F.lit("qrels").alias("file"), "ord", "error")
    return found.isEmpty(), found, D.dataset_stats(docs, queries, L.load_qrels(rows))


def main(args: list[str]) -> int:
    """python -m lodestar.plans.report evaluate PREDICTIONS REFERENCES | errors PREDICTIONS QRELS | validate FOLDER"""
    from ..runtime import session

    spark = session("report")
    if args[:1] == ["evaluate"]:
        with open(args[2]) as f:
            refs = spark.createDataFrame(list(json.load(f).items()), "qid string, answer string")
        evaluate(L.load_predictions(spark, args[1]), refs).show(truncate=False)
    elif args[:1] == ["errors"]:
        for t in errors(L.load_predictions(spark, args[1]), L.load_qrels(L.lines(spark, args[2]), strict=True)):
            t.show(truncate=False)
    elif args[:1] == ["validate"]:
        ok, found, stats = validate(spark, args[1])
        for r in found.toLocalIterator():
            print(r.file, r.ord, r.error)
        if stats is not None:
            stats.show(truncate=False)
        return int(not ok)
    else:
        print(main.__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
