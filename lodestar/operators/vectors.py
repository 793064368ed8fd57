"""Dense and quantised vector similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import shipped
from .scoring import top_k

#: Query vectors that are sent to the executors at once.
BLOCK = 4096


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def top_by_dot(corpus: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """qid, doc_id, score, rank: the k vectors of largest inner product with each query.

    corpus: doc_id, v, scale; queries: qid, v, scale; the product is multiplied by both scales.
    Queries go out in blocks of BLOCK; a task keeps the k best of each, with ties, of what it
    has read, so no pair beyond those is ever a row. least: inclusive minimum score, applied
    after the ranking.
    """
    out = None
    kinds = "qid long, doc_id long, score double"
    total = queries.count()
    blocks = max(1, -(-total // BLOCK) * 2 if total > BLOCK else 1)
    for i in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).select("qid", doubles(F.col("v")).alias("v"), F.col("scale").cast("double").alias("scale")).collect()
        if not rows:
            continue
        ids = np.array([r.qid for r in rows], np.int64)
        q = np.array([r.v for r in rows]) * np.array([r.scale for r in rows])[:, None]

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = b.column("v").combine_chunks() if isinstance(b.column("v"), pa.ChunkedArray) else b.column("v")
                m = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) * b.column("scale").to_numpy()[:, None]
                s = np.round(q @ m.T, 6)
                cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                at, doc = np.nonzero(s >= cut[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), b.column("doc_id").take(pa.array(doc)), pa.array(s[at, doc])], names=["qid", "doc_id", "score"])

        part = shipped(corpus).filter(F.col("v").isNotNull()).select("doc_id", doubles(F.col("v")).alias("v"), F.col("scale").cast("double").alias("scale")).mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], kinds)
    ranked = top_k(out, k, "qid")
    return ranked if least is None else ranked.filter(F.col("score") >= least)


def quantise_symmetric(v: Column, rounding: str = "half_even") -> tuple[Column, Column]:
    """(int8 values, scale). half_even: scale is the largest magnitude, steps of scale / 127;
    truncate: scale is the step itself."""
    d = doubles(v)
    most = F.array_max(F.transform(d, F.abs))
    if rounding == "half_even":
        scale = F.greatest(most, F.lit(1e-8))
        return F.transform(d, lambda x: F.rint(x / scale * 127).cast("int").cast("tinyint")), scale
    scale = F.when(most > 0, most / 127).otherwise(1.0)
    return F.transform(d, lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), (x / scale).cast("int"))).cast("tinyint")), scale


def quantise_asymmetric(v: Column, rounding: str = "half_even") -> tuple[Column, Column, Column]:
    """(values 0 to 255 as smallint, scale, zero point)."""
    d = doubles(v)
    low, high = F.array_min(d), F.array_max(d)
    scale = F.when(high > low, (high - low) / 255).otherwise(1.0)

    def q(x: Column) -> Column:
        y = (x - low) / scale
        y = F.rint(y) if rounding == "half_even" else y
        return F.least(F.lit(255), F.greatest(F.lit(0), y.cast("int"))).cast("smallint")

    return F.transform(d, q), scale, low


def dequantise(q: Column, scale: Column, zero_point: Column | None = None) -> Column:
    zero = F.lit(0.0) if zero_point is None else zero_point
    return F.transform(doubles(q), lambda x: x * scale + zero)
