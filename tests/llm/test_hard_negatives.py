from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, place string, score string, rank string"


def brute(rows, anchor, k=5):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(min(((i, v) for i, v, _ in kept if v), default=(0, []))[1])
    kept = [r for r in kept if len(r[1]) == size]
    out = []
    for i, v, label in kept:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, own == label) for j, w, own in kept if j != i)
        for p, pid, _ in [s for s in scored if s[2]][:k]:
            found = [s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, pid, r, s[1], -p, -s[0]) for r, s in enumerate(found, 1)]
    return sorted(out)


def rows_of(seed, n=400):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in rnd.sample(range(5000), n):
        c = rnd.choice(centres)
        rows.append((i, [float(np.float32(x + rnd.gauss(0, 0.2))) for x in c], rnd.choice([0, 1, 2, 3, None])))
    rows += [(6000 + i, rows[0][1], i % 3) for i in range(40)]  # copies of one vector: ties
    rows += [(7000, [0.0] * 6, 1), (7010, [0.0] * 6, 2), (7020, [0.0] * 6, 1), rows[5], rows[5], (rows[6][0], rows[7][1], 2), (None, rows[8][1], 1)]
    return rows + [(8000, None, 1), (8010, [1.0] * 5 + [None], 1), (8020, [1.0] * 5 + [math.nan], 1), (8030, [math.inf] + [1.0] * 5, 2), (8040, [1.0], 1), (8050, [], 1)]


@pytest.mark.parametrize(("tree", "anchors", "leaf"), [(16 << 20, 4 << 20, 256), (2000, 500, 4)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, tree, anchors, leaf):
    monkeypatch.setattr(H, "TREE_BYTES", tree)
    monkeypatch.setattr(H, "ANCHOR_BYTES", anchors)
    monkeypatch.setattr(H, "LEAF", leaf)
    rows = rows_of(leaf, 400 if leaf > 4 else 150)
    got = H.mine(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_empty_table_and_no_anchors(spark):
    assert H.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    df = spark.createDataFrame([(1, [1.0], 1, "", "", ""), (2, [1.0], 2, "", "", "")], SCHEMA)
    assert H.mine(df, F.lit(False)).collect() == []
    assert H.mine(df, F.lit(True)).collect() == []  # no positives


def test_bounds_prune_from_above_and_below():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 400, (40, 8))
    x = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 10, (8000, 8)))
    label, ids = rng.integers(0, 3, 8000), rng.permutation(8000)
    tree = H.Tree(x.copy(), label.copy(), ids.copy(), leaf=64)
    q = H.Anchors(x[:50], label[:50], ids[:50])
    kept = [H.Kept(50, 5)]
    positive = H.search(tree, q, kept)
    scores = x[:50] @ x.T
    for i in range(50):
        own = sorted((-scores[i, j], ids[j]) for j in range(8000) if label[j] == label[i] and j != i)[:5]
        assert [(-s, d) for s, d in own] == [(s, d) for a, s, d in zip(kept[0].query, kept[0].score, kept[0].id, strict=True) if a == i]
    assert positive < 0.2 * 50 * 8000
    best = np.array([max(scores[i, label == label[i]]) for i in range(50)])[:, None]
    q.low, q.high = np.ceil(0.8 * best), np.floor(0.82 * best)  # a window: both bounds prune
    kept = [H.Kept(50, 5)]
    inside = H.search(tree, q, kept)
    for i in range(50):
        own = sorted((-scores[i, j], ids[j]) for j in range(8000) if label[j] != label[i] and q.low[i, 0] <= scores[i, j] <= q.high[i, 0])[:5]
        assert [(-s, d) for s, d in own] == [(s, d) for a, s, d in zip(kept[0].query, kept[0].score, kept[0].id, strict=True) if a == i]
    assert inside < 0.5 * 50 * 8000
