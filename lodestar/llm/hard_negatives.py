"""Hard negatives by ball trees: branch and bound on inner products, from above and from below.

A vector becomes integers, floor(256 * x), as doubles; a row's score is its inner product with an anchor. Each task
builds a ball tree of every TREE_BYTES of the vectors it reads and searches it for all anchors of a block at once. A node has a
centre, a radius and a range of labels, and an inner product within it lies within |anchor| * radius of the centre's.
Nodes are pruned for an anchor where the labels rule them out, where the bounds lie outside of its score window, and where
the upper bound is strictly beneath its k-th best score so far (ties may still have smaller ids). What is left in a leaf
is scored exactly. Each task returns the k best of each anchor, and those meet in a shuffle.

First the positives are found, the best rows of an anchor's label. Their scores give the windows
of the second search, among rows of other labels. Anchors go out in blocks of ANCHOR_BYTES, each against all rows; each block's rows are
written before the next block, so neither plan nor memory grows with their number.

Rows with a null label, a null vec_id, a null vector, or any null or non-finite component take no part, nor do those whose vector
is not as long as that of the smallest vec_id. Rows that repeat a vec_id each count, as anchors too, but
none is an anchor's own other row. Ties go to the smaller vec_id. Integers are held within 2^24 in magnitude; scores are exact
below 2^53. No anchors, no positives or an empty table give no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import top_k
from ..runtime import materialise, scratch_path, shipped, table
from .vector_rows import blocks, finite, first_rows

POSITIVES, NEGATIVES = 5, 5
#: A negative's score as a percentage of its positive's: from, to, both included.
LOW, HIGH = 80, 100
#: Bytes of vectors, as doubles, in a tree and in a block of anchors, and rows of a leaf.
TREE_BYTES, ANCHOR_BYTES, LEAF = 16 << 20, 4 << 20, 256
_NONE = np.iinfo(np.int64).max


class Tree:
    """A ball tree of vectors; subtrees are of one label as soon as a cut between labels allows it."""

    def __init__(self, x: np.ndarray, label: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(label, kind="stable")
        self.x, self.label, self.ids = x[order], label[order], ids[order]
        self.centre, self.radius, self.labels, self.rows, self.children = [], [], [], [], []
        self._grow(0, len(x), leaf)

    def _grow(self, a: int, z: int, leaf: int) -> int:
        own, node = self.x[a:z], len(self.rows)
        centre = own.mean(axis=0)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
        self.labels.append((self.label[a:z].min(), self.label[a:z].max()))
        self.rows.append((a, z))
        self.children.append(())
        if z - a > leaf:
            if self.labels[node][0] < self.labels[node][1]:
                cuts = np.flatnonzero(np.diff(self.label[a:z])) + 1
                cut = a + int(cuts[np.argmin(np.abs(cuts - (z - a) // 2))])
            else:
                cut, widest = a + (z - a) // 2, int(np.argmax(np.ptp(own, axis=0)))
                order = a + np.argpartition(own[:, widest], cut - a)
                self.x[a:z], self.ids[a:z] = self.x[order], self.ids[order]
            self.children[node] = (self._grow(a, cut, leaf), self._grow(cut, z, leaf))
        return node


class Kept:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of the queries (rows) with the ids (columns); -inf rules a pair out."""
        cut = self.least[queries]
        if scores.shape[1] > self.k:
            cut = np.maximum(cut, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        query, score, id_ = np.concatenate([self.query, queries[row]]), np.concatenate([self.score, scores[row, col]]), np.concatenate([self.id, ids[col]])
        order = np.lexsort((id_, -score, query))
        query = query[order]
        first = np.searchsorted(query, np.arange(len(self.least) + 1))
        stay = np.arange(len(query)) - first[query] < self.k
        self.query, self.score, self.id = query[stay], score[order][stay], id_[order][stay]
        last = np.searchsorted(self.query, np.arange(len(self.least)), "right") - 1
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.least)) >= self.k)
        self.least[full] = self.score[last[full]]


@dataclass
class Anchors:
    """A block of anchors; low and high are the windows of each, one column a positive, where there are any."""

    x: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def search(tree: Tree, q: Anchors, kept: list[Kept]) -> int:
    """Add the tree's rows to kept: without windows those of an anchor's label, with windows those of other labels, one kept
    a column. The number of leaf rows that were scored, over all anchors."""
    length, scored = np.sqrt((q.x * q.x).sum(axis=1)), 0
    todo = [(0, np.arange(len(q.x)))]
    while todo:
        node, own = todo.pop()
        low, high = tree.labels[node]
        label = q.label[own]
        own = own[(low <= label) & (label <= high)] if q.low is None else own[(low < high) | (label != low)]
        middle, reach = q.x[own] @ tree.centre[node], length[own] * tree.radius[node]
        slack = 1e-9 * (np.abs(middle) + reach + 1)
        top, bottom = middle + reach + slack, middle - reach - slack
        if q.low is None:
            own = own[top >= kept[0].least[own]]
        else:
            least = np.stack([k.least[own] for k in kept], 1)
            own = own[((top[:, None] >= np.maximum(q.low[own], least)) & (bottom[:, None] <= q.high[own])).any(axis=1)]
        if not len(own):
            continue
        if tree.children[node]:
            near = [float((q.x[own] @ tree.centre[c]).mean()) for c in tree.children[node]]
            todo += [(c, own) for _, c in sorted(zip(near, tree.children[node], strict=True))]
            continue
        a, z = tree.rows[node]
        for i in range(a, z, LEAF):  # copies of one vector may be more
            j = min(z, i + LEAF)
            scores = q.x[own] @ tree.x[i:j].T
            scored += scores.size
            alike = tree.label[i:j][None] == q.label[own][:, None]
            if q.low is None:
                kept[0].add(own, np.where(alike & (tree.ids[i:j][None] != q.ids[own][:, None]), scores, -np.inf), tree.ids[i:j])
            else:
                for w, k in enumerate(kept):
                    inside = (scores >= q.low[own, w][:, None]) & (scores <= q.high[own, w][:, None])
                    k.add(own, np.where(inside & ~alike, scores, -np.inf), tree.ids[i:j])
    return scored


def _searched(sent, size: int, k: int):
    """Vectors -> of each anchor's place and window the k best (id, score) that the task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Anchors = sent.value
        windows = 1 if q.low is None else q.low.shape[1]
        kept, held = [Kept(len(q.x), k) for _ in range(windows)], []

        def flush() -> None:
            search(Tree(*[np.concatenate(c) for c in zip(*held, strict=True)]), q, kept)
            held.clear()

        for part, x in blocks(batches, size):
            held.append((x, part.column("label").to_numpy(), part.column("vec_id").to_numpy()))
            if sum(h[0].nbytes for h in held) >= TREE_BYTES:
                flush()
        if held:
            flush()
        for w, found in enumerate(kept):
            cols = [pa.array(found.query), pa.array(np.full(len(found.query), w)), pa.array(found.id), pa.array(found.score.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["place", "window", "vec_id", "score"])

    return run


def _best(rows: DataFrame, q: Anchors, size: int, k: int) -> DataFrame:
    """place, window, vec_id, score, rank."""
    sent = rows.sparkSession.sparkContext.broadcast(q)
    found = shipped(rows).mapInArrow(_searched(sent, size, k), "place long, window long, vec_id long, score long")
    return materialise(top_k(found, k, "place", "window", id_="vec_id"), "best-rows")


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """vectors (vec_id, embedding, label), anchor: which rows are anchors -> anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score: of each anchor and positive the best negatives with low * positive_score <= 100 *
    negative_score <= high * positive_score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    head = first_rows(rows.filter(F.size("embedding") > 0), 1)
    if not head:
        return spark.createDataFrame([], kinds)
    size = len(head[0].embedding)
    rows = rows.filter(F.size("embedding") == size)
    asked = materialise(rows.filter(anchor).withColumn("_b", F.xxhash64(F.monotonically_increasing_id())), "anchors")
    parts = max(1, -(-asked.count() * size * 8 // ANCHOR_BYTES))
    path = scratch_path(spark, "hard-negatives")
    spark.createDataFrame([], kinds).write.parquet(path)
    for i in range(parts):
        own = asked.filter(F.pmod("_b", F.lit(parts)) == i).drop("_b").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        own = [x for x in blocks(iter(own.to_batches()), size)]
        q = Anchors(np.concatenate([x for _, x in own]), *[np.concatenate([b.column(c).to_numpy() for b, _ in own]) for c in ("label", "vec_id")])
        best = _best(rows, q, size, positives)
        scores, ids = np.full((len(q.x), positives), np.nan), np.full((len(q.x), positives), _NONE)
        for r in best.collect():  # at most `positives` an anchor of the block
            scores[r.place, r["rank"] - 1], ids[r.place, r["rank"] - 1] = r.score, r.vec_id
        # whole numbers, as scores are: none fits where there is no positive
        q.low, q.high = np.nan_to_num(np.ceil(low * scores / 100), nan=np.inf), np.nan_to_num(np.floor(high * scores / 100), nan=-np.inf)
        names = [(p, w, int(q.ids[p]), int(ids[p, w]), int(scores[p, w])) for p, w in zip(*np.nonzero(ids != _NONE), strict=True)]
        names = [(int(p), int(w), a, b, s) for p, w, a, b, s in names]
        if not names:
            continue
        named = F.broadcast(spark.createDataFrame(names, "place long, window long, anchor_id long, positive_id long, positive_score long"))
        found = _best(rows, q, size, negatives).join(named, ["place", "window"])
        found = found.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.write.mode("append").parquet(path)
    return spark.read.schema(kinds).parquet(path)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


OP13_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES}
)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INT AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= {NEGATIVES}
"""
