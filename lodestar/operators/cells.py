"""Exact vector search by cells: vectors of one centre lie together, and cells that cannot hold a hit are not read.

Up to CENTRES centres are fitted on SAMPLE vectors at most; every vector belongs to the cell of its nearest centre, and a cell's
radius is the distance of its farthest one. By the triangle inequality no inner product of a query with a cell's vectors
exceeds that with the centre by more than |query| * radius. So a query is first compared with the cells of the best bounds
that hold k vectors, which gives a score that its k-th best cannot be below, and then with the cells whose bound reaches that score.
The sample decides how many cells are left out, never what is found.

Cells are kept in the shared folder by content, as indexes are: a folder for each cell, cells of more than CELL_ROWS vectors
in several files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialise, scratch_path, shared_dir, shipped
from .index import _content_key
from .scoring import top_k
from .vectors import BLOCK, doubles

#: Centres, vectors that they are fitted on, rounds of fitting, and vectors of a file.
CENTRES, SAMPLE, ROUNDS, CELL_ROWS = 1024, 20_000, 6, 1 << 20
#: Part of the folder's name: to be raised when the files are written otherwise.
VERSION = 1
#: Scores that a task holds at a time, and what rounded scores and bounds may differ by.
_CELLS, _NEAR = 1 << 22, 2e-6


@dataclass
class Cells:
    """rows (cell, doc_id, v: scaled), centres (cell, centre, radius, n)."""

    rows: DataFrame
    centres: DataFrame


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """k centres or fewer, by Lloyd's rounds from evenly spread rows of the sample."""
    centres = np.unique(sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)], axis=0)
    for _ in range(ROUNDS):
        own = nearest(sample, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centre and the distance."""
    squares = (centres * centres).sum(axis=1)
    step = max(1, _CELLS // len(centres))
    own = np.concatenate([np.argmin(squares - 2 * x[i : i + step] @ centres.T, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1))


def _assigned(centres: np.ndarray):
    size = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("v"), size) * b.column("scale").to_numpy()[:, None]
            own, apart = nearest(x, centres)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column("doc_id"), v, pa.array(apart)], names=["cell", "doc_id", "v", "apart"])

    return run


def build(corpus: DataFrame, path: str) -> None:
    """Write the cells of corpus (doc_id, v, scale) under path; the whole appears at once. Null vectors are left out, and those of another length than
    that of the smallest doc_id."""
    spark = corpus.sparkSession
    rows = corpus.filter(F.col("v").isNotNull()).select(F.col("doc_id").cast("long"), doubles(F.col("v")).alias("v"), F.col("scale").cast("double").alias("scale"))
    head = rows.orderBy("doc_id").limit(1).collect()
    size = len(head[0].v) if head else 0
    rows = rows.filter(F.size("v") == size)
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("v", "scale").toArrow().combine_chunks()
    sample = _vectors(sample["v"].combine_chunks(), size) * sample["scale"].to_numpy()[:, None] if n else np.zeros((1, size))
    centres = fit(sample, min(CENTRES, max(1, int(np.ceil(np.sqrt(n))))))
    found = materialise(shipped(rows).mapInArrow(_assigned(centres), "cell int, doc_id long, v array<double>, apart double"), "assigned")
    per = {r.cell: r for r in found.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()}  # a row a centre
    salts = F.broadcast(spark.createDataFrame([(c, -(-r.n // CELL_ROWS)) for c, r in per.items()], "_c int, _s long"))
    dealt = found.join(salts, F.col("cell") == F.col("_c")).repartition("cell", F.pmod(F.xxhash64("doc_id"), F.col("_s")))
    own = f"{path}_{uuid.uuid4().hex}"
    dealt.sortWithinPartitions("cell").select("cell", "doc_id", "v").write.partitionBy("cell").parquet(f"{own}/rows")
    stats = [(c, centres[c].tolist(), r.radius, r.n) for c, r in per.items()]
    spark.createDataFrame(stats, "cell int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{own}/centres")
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (own, path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to) or not fs.rename(at, to):
        fs.delete(at, True)  # another session was first


def load(spark: SparkSession, path: str) -> Cells | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/centres/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return Cells(spark.read.schema("doc_id long, v array<double>, cell int").parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centres"))


def kept(corpus: DataFrame) -> Cells:
    """The cells of corpus (doc_id, v, scale) in the shared folder, built at first use."""
    spark = corpus.sparkSession
    path = f"{shared_dir(spark)}/lodestar/cells-{VERSION}/{_content_key(corpus, 'doc_id', 'v', 'scale')}"
    found = load(spark, path)
    if found is None:
        build(corpus, path)
        found = load(spark, path)
    return found


def of(corpus: DataFrame) -> Cells:
    """The cells of corpus, for this session."""
    path = scratch_path(corpus.sparkSession, "cells")
    build(corpus, path)
    return load(corpus.sparkSession, path)


def _compared(sent, k: int):
    """Vectors of cells -> of each query that a cell is read for the k best of the task, with ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, active = sent.value
        least = np.full((len(q), k), -np.inf)
        for b in batches:
            cell = b.column("cell").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)] if len(cell) else [0]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                own = active.get(int(cell[a]))
                if own is None:
                    continue
                x, ids = _vectors(b.column("v").slice(a, z - a), q.shape[1]), b.column("doc_id").slice(a, z - a)
                for i in range(0, len(own), max(1, _CELLS // (z - a))):
                    asked = own[i : i + max(1, _CELLS // (z - a))]
                    s = np.round(q[asked] @ x.T, 6)
                    held = np.concatenate([least[asked], s], axis=1)
                    least[asked] = np.partition(held, -k, axis=1)[:, -k:]
                    place, at = np.nonzero(s >= least[asked].min(axis=1)[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(asked[place]), ids.take(pa.array(at)), pa.array(s[place, at])], names=["place", "doc_id", "score"])

    return run


def _read(cells: Cells, q: np.ndarray, wanted: np.ndarray, names: np.ndarray, k: int) -> DataFrame:
    """(place, doc_id, score) of the wanted cells of each query."""
    active = {int(names[c]): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(axis=0))}
    sent = cells.rows.sparkSession.sparkContext.broadcast((q, active))
    rows = cells.rows.filter(F.col("cell").isin(list(active))).select("cell", "doc_id", "v")
    found = shipped(rows).mapInArrow(_compared(sent, k), "place long, doc_id long, score double")
    return materialise(top_k(found, k, "place").drop("rank"), "best-of-cells")


def search(corpus: DataFrame | Cells, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """qid, doc_id, score, rank: the k vectors of largest inner product with each query, ties to the smaller id.

    corpus: doc_id, v, scale, or cells of it; queries: qid, v, scale. Queries go out in blocks of BLOCK. least: inclusive minimum score,
    applied after the ranking.
    """
    cells = corpus if isinstance(corpus, Cells) else kept(corpus)
    spark, own = queries.sparkSession, cells.centres.collect()  # CENTRES rows at most
    names, n = np.array([r.cell for r in own], int), np.array([r.n for r in own], int)
    total, out = queries.count(), None
    blocks = max(1, -(-total // BLOCK) * 2 if total > BLOCK else 1)
    for i in range(blocks if own else 0):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        rows = part.select("qid", doubles(F.col("v")).alias("v"), F.col("scale").cast("double").alias("scale")).filter(F.size("v") == len(own[0].centre)).collect()
        if not rows:
            continue
        q = np.array([r.v for r in rows]) * np.array([r.scale for r in rows])[:, None]
        centres, radius = np.array([r.centre for r in own]), np.array([r.radius for r in own])
        bounds = q @ centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius * (1 + 1e-9) + _NEAR
        order = np.argsort(-bounds, axis=1)
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        best = _read(cells, q, first, names, k)
        w = Window.partitionBy("place").orderBy(F.desc("score"))
        reached = np.full(len(q), -np.inf)
        for r in best.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == k).collect():  # a row a query
            reached[r.place] = r.score
        second = (bounds >= reached[:, None]) & ~first
        if second.any():
            best = best.unionByName(_read(cells, q, second, names, k))
        named = F.broadcast(spark.createDataFrame(list(enumerate(r.qid for r in rows)), "_place long, qid long"))
        found = best.join(named, F.col("place") == F.col("_place")).select("qid", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "qid long, doc_id long, score double")
    ranked = top_k(out, k, "qid")
    return ranked if least is None else ranked.filter(F.col("score") >= least)
