"""Vectors compressed to codes of nearest codebook entries, found by annular norm pruning.

A vector becomes integers, floor(256 * x), and is cut into PARTS equal parts. The codebook of a part
starts as that part of the ENTRIES vectors of the smallest vec_ids; each of ROUNDS rounds assigns every part to its nearest
entry, ties to the lower index, and replaces each entry by the floors of its parts' means. Unused entries stay.

Nearest entries: a codebook is sorted by norm. By the triangle inequality an entry is no nearer than its norm
differs from the part's, so a few entries of nearly the same norm give a distance, a binary search the interval of norms
that this distance allows, both ends included, and the entries of that annulus alone are evaluated, in exact integers.

Each task adds up the parts of each entry where they are; only these sums are shuffled and reach the driver, as many as
codebooks have components. Codebooks go to the tasks; their size follows from PARTS, ENTRIES and the vectors' length.

Rows whose vector is null, or holds null or non-finite components, are dropped, and so are those whose length isn't
that of the row of the smallest vec_id that has a positive multiple of PARTS. Integers are held within 2^24 in magnitude, vectors of
32,768 components at most have exact errors then. Fewer rows than ENTRIES make smaller codebooks. Rows that repeat a vec_id each count and each
have a code; null vec_ids come last. Null labels are one label. An empty table gives an empty one; other columns play
no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, shipped, table
from .joins import looked_up
from .vector_rows import blocks, finite, first_rows

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of nearly a part's norm that give the first distance, and pairs that are evaluated at a time.
_PROBES, _PAIRS = 12, 1 << 19


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x the index of the nearest entry, the squared distance, and how many pairs were evaluated in all."""
    order = np.argsort((entries * entries).sum(axis=1), kind="stable")
    sorted_, norms = entries[order], np.sqrt((entries[order] ** 2).sum(axis=1).astype(float))
    own = np.sqrt((x * x).sum(axis=1).astype(float))
    k = min(_PROBES, len(entries))
    at = np.clip(np.searchsorted(norms, own) - k // 2, 0, len(entries) - k)
    reach = np.full(len(x), np.iinfo(np.int64).max)
    for j in range(k):
        reach = np.minimum(reach, ((x - sorted_[at + j]) ** 2).sum(axis=1))
    reach = np.sqrt(reach.astype(float))
    slack = 1e-9 * (own + reach + 1)
    low, high = np.searchsorted(norms, own - reach - slack, "left"), np.searchsorted(norms, own + reach + slack, "right")
    many = high - low
    index, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    ends = np.cumsum(many)
    i = 0
    while i < len(x):
        z = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIRS, "right")))
        m = many[i:z]
        first = np.cumsum(m) - m
        entry = np.arange(m.sum()) - np.repeat(first - low[i:z], m)
        row = np.repeat(np.arange(i, z), m)
        distance = ((x[row] - sorted_[entry]) ** 2).sum(axis=1)
        least[i:z] = np.minimum.reduceat(distance, first)
        index[i:z] = np.minimum.reduceat(np.where(distance == least[row], order[entry], len(entries)), first)
        i = z
    return index, least, int(ends[-1]) if len(x) else 0


def _parts(x: np.ndarray, parts: int) -> Iterator[np.ndarray]:
    yield from np.moveaxis(x.astype(np.int64).reshape(len(x), parts, -1), 1, 0)


def _sums(books: np.ndarray, size: int):
    """Vectors -> of each part and entry the count and the sums of its parts, one set of rows a task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, x in blocks(batches, size):
            for p, own in enumerate(_parts(x, parts)):
                at, _, _ = nearest(own, books[p])
                count[p] += np.bincount(at, minlength=entries)
                for j in range(width):
                    total[p, :, j] += np.bincount(at, own[:, j].astype(float), entries).astype(np.int64)
        p, e = np.nonzero(count)
        p, e, j = np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p))
        cols = [p, e, j, total[p, e, j], count[p, e]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["part", "entry", "place", "total", "n"])

    return run


def _coded(books: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, size):
            found = [nearest(own, books[p])[:2] for p, own in enumerate(_parts(x, len(books)))]
            codes = np.stack([i for i, _ in found], 1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def train(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of rows, whose vectors all have `size` components."""
    first = pa.RecordBatch.from_pydict({"embedding": pa.array([r.embedding for r in first_rows(rows, entries)], pa.list_(pa.float64()))})
    books = np.concatenate([x for _, x in blocks(iter([first]), size)]).astype(np.int64)
    books = np.ascontiguousarray(np.moveaxis(books.reshape(len(books), parts, -1), 1, 0))
    for _ in range(rounds):
        sums = shipped(rows.select("embedding")).mapInArrow(_sums(books, size), "part long, entry long, place long, total long, n long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part, r.entry, r.place] = r.total // r.n
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256."""
    if entries > 256:
        raise ValueError("an index has two hex digits: 256 entries at most")
    rows = vectors.select("vec_id", "embedding", "label").filter(finite(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    head = first_rows(rows, 1)
    size = len(head[0].embedding) if head else parts
    rows = rows.filter(F.size("embedding") == size)
    books = train(rows, size, parts, entries, rounds) if head else np.zeros((parts, 1, 1), np.int64)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kinds = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    coded = materialise(shipped(rows).mapInArrow(_coded(books, size), kinds), "codes").withColumn("key", F.struct("label"))
    per = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    per = materialise(per, "label-errors")
    found = looked_up(coded, "key", per.drop("n"), per.select("key", "n"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    out = f"""
WITH k AS (
  SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x FROM k, (SELECT unnest(range({PARTS})) AS part)
), c0 AS MATERIALIZED (
  SELECT part, e, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {ENTRIES}
)"""
    for i in range(ROUNDS + 1):
        out += f""", a{i} AS MATERIALIZED (
  SELECT vec_id, part, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)])::BIGINT * {ENTRIES} + e) AS best
  FROM p JOIN c{i} USING (part) GROUP BY vec_id, part
)"""
        if i < ROUNDS:
            out += f""", m{i} AS (
  SELECT part, best % {ENTRIES} AS e, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{i} JOIN p USING (vec_id, part)
), f{i} AS (
  SELECT part, e, list(c ORDER BY j) AS c FROM (SELECT part, e, j, floor(sum(y) / count(*))::BIGINT AS c FROM m{i} GROUP BY ALL) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(f.c, o.c) AS c FROM c{i} o LEFT JOIN f{i} f USING (part, e)
)"""
    return out + f""", h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{ROUNDS}
), r AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), h
"""


OP12_SQL = _sql()
