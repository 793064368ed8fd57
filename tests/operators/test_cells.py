"""Exact vector search by cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import cells as X
from lodestar.operators import vectors as V

ROWS = "doc_id long, v array<float>, scale double"


def made(seed, n, groups=40, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, size))
    return (centres[rng.integers(0, groups, n)] + rng.normal(0, 0.03, (n, size))).astype(np.float32)


def frame(spark, x, ids=None, scale=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v], 1.0 if scale is None else scale[j]) for j, (i, v) in enumerate(zip(ids, x, strict=True))], ROWS)


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())


def read_rows(monkeypatch):
    """Vectors that are compared with some query, and pairs."""
    seen, keep = [], X._read

    def read(cells, q, wanted, names, k):
        n = {r.cell: r.n for r in cells.centres.collect()}
        seen.append(sum(n[int(names[c])] * int(wanted[:, c].sum()) for c in range(len(names))))
        return keep(cells, q, wanted, names, k)

    monkeypatch.setattr(X, "_read", read)
    return seen


@pytest.mark.parametrize("k", [1, 10, 500])
def test_hits_are_those_of_all_pairs(spark, k):
    x = [*made(k, 300), None, *made(1, 1)] + [made(2, 1)[0]] * 30  # copies: ties
    scale = [1.0 + (i % 3) for i in range(len(x))]
    corpus = frame(spark, x, range(1000, 1000 + len(x)), scale).repartition(3)
    queries = frame(spark, [*made(7, 20), *x[:5], [0.0] * 8], scale=[0.5] * 26).withColumnRenamed("doc_id", "qid")
    assert rows(X.search(corpus, queries, k)) == rows(V.top_by_dot(corpus, queries, k))
    assert rows(X.search(corpus, queries, k, 0.5)) == rows(V.top_by_dot(corpus, queries, k, 0.5))


def test_cells_out_of_reach_are_not_read(spark, monkeypatch):
    x = made(3, 4000)
    corpus, queries = frame(spark, x), frame(spark, x[:40]).withColumnRenamed("doc_id", "qid")
    seen = read_rows(monkeypatch)
    got = X.search(corpus, queries, 10)
    want = {i: {int(j) for j in np.lexsort((np.arange(4000), -np.round(x[i].astype(float) @ x.T.astype(float), 6)))[:10]} for i in range(40)}
    found = {i: set() for i in range(40)}
    for r in got.collect():
        found[r.qid].add(r.doc_id)
    assert found == want  # recall 1
    assert sum(seen) < 0.3 * 40 * 4000
    few = X.kept(corpus).rows.filter(F.col("cell").isin([0, 1]))
    assert 0 < few.count() < 1000


def test_few_and_no_vectors(spark):
    none, one = frame(spark, []), frame(spark, made(1, 1))
    asked = one.withColumnRenamed("doc_id", "qid")
    assert rows(X.search(none, asked, 3)) == [] == rows(X.search(one, asked.filter("qid < 0"), 3)) == rows(X.search(frame(spark, [None]), asked, 3))
    assert [r[:2] for r in rows(X.search(one, asked, 3))] == [(0, 0)]


def test_a_large_cell_lies_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(X, "CELL_ROWS", 50)
    x = [made(1, 1)[0]] * 400 + list(made(2, 100))
    corpus, queries = frame(spark, x), frame(spark, x[395:405]).withColumnRenamed("doc_id", "qid")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one task writes all that is so small
    try:
        cells = X.of(corpus)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = cells.rows.withColumn("file", F.input_file_name()).groupBy("cell").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).first()
    assert files.n >= 400 and files.files >= 2
    assert rows(X.search(cells, queries, 20)) == rows(V.top_by_dot(corpus, queries, 20))
