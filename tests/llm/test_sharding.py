from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import sharding

SCHEMA = "doc_id long, text string, shard string, shard_id int"


def spread(sums):
    return max(sums) - min(sums)


def test_differencing_beats_the_greedy_rule():
    rnd = random.Random(3)
    for k in (2, 3, 8):
        total = greedy = 0
        for _ in range(20):
            w = [rnd.randint(1, 10_000) for _ in range(60)]
            sums, members = sharding.difference([(x, i) for i, x in enumerate(w)], k)
            assert sorted(i for m in members for i in m) == list(range(60))
            assert [sum(w[i] for i in m) for m in members] == sums
            bins = [0] * k
            for x in sorted(w, reverse=True):
                bins[bins.index(min(bins))] += x
            total, greedy = total + spread(sums), greedy + spread(bins)
        assert total < greedy


def test_the_textbook_case():
    sums, _ = sharding.difference([(x, x) for x in (8, 7, 6, 5, 4)], 2)
    assert sorted(sums) == [14, 16]


def plain_differencing(weights, k):
    """The two partial partitions of largest spread, the earlier of equals, are added in opposite order."""
    parts = [[0] * (k - 1) + [w] for w in weights]
    while len(parts) > 1:
        order = sorted(range(len(parts)), key=lambda i: (parts[i][0] - parts[i][-1], i))
        a, b = parts[order[0]], parts[order[1]]
        parts = [p for i, p in enumerate(parts) if i not in order[:2]] + [sorted(x + y for x, y in zip(a, reversed(b), strict=True))]
    return parts[0]


def test_groups_against_plain_differencing(spark):
    rnd = random.Random(6)
    for k in (2, 5, 40):
        groups = [(f"{i:03}", int(rnd.paretovariate(0.8) * 50) + 16) for i in range(rnd.randint(60, 220))]
        groups = [(g, w + 16 * sum(x[1] for x in groups) // 40_960) for g, w in groups]  # each above the bound of large ones
        sums = Counter()
        size = dict(groups)
        for r in sharding.assign_groups(spark.createDataFrame(groups, "group_key string, weight long"), k).collect():
            sums[r.shard] += size[r.group_key]
        want = plain_differencing(sorted(size.values(), reverse=True), k)
        assert sorted(sums[i] for i in range(k)) == want


@pytest.fixture
def rows():
    rnd = random.Random(4)
    rows = [(i, "é" * int(rnd.paretovariate(0.9) % 4000 + 1) + str(rnd.randrange(900)), "clash", 7) for i in range(2500)]
    rows += [(9000 + i, "the same text", "", 0) for i in range(300)] + [(9500, None, "", 0), (9501, "", "", 0), (9502, "", "", 0), (None, "x", "", 0), (3, rows[3][1], "", 0)]
    return rows


@pytest.mark.parametrize("leaf", [50_000, 400])
def test_shards(spark, rows, leaf, monkeypatch):
    monkeypatch.setattr(sharding, "LEAF_GROUPS", leaf)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted([(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows], key=key)
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in got], key=key) == want
    sums, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    text = {i: t or "" for i, t, *_ in rows}
    for r in got:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shards[text[r.doc_id]].add(r.shard)
    assert set(sums) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    biggest = max(Counter({t: sum(len(x[1].encode()) + 16 for x in rows if x[1] == t) for t in {x[1] for x in rows if x[1]}}).values())
    fair = sum(sums.values()) / 40
    assert max(sums.values()) <= max(biggest, 1.01 * fair)


def test_a_group_beyond_a_fair_share_stands_almost_alone(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAF_GROUPS", 500)
    groups = [(f"{i:04}", 100 + i % 7) for i in range(4000)] + [("big", 30_000)]
    df = spark.createDataFrame(groups, "group_key string, weight long")
    size = dict(groups)
    sums, shard = Counter(), {}
    for r in sharding.assign_groups(df).collect():
        sums[r.shard] += size[r.group_key]
        shard[r.group_key] = r.shard
    assert len(shard) == 4001
    assert sums.pop(shard["big"]) == 30_000
    assert spread(sums.values()) <= 500


def test_documents_keep_their_columns(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shard_documents(df)
    assert out.columns == [*df.columns, "_shard_id"]
    assert out.count() == len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sharding.shard(df).collect() == [] and sharding.shard_documents(df).collect() == []


def test_rows_that_repeat_id_and_text_share_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAF_GROUPS", 4)
    df = spark.createDataFrame([(None, "same text")] * 2000 + [(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    seen, keep = [], sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda d, label: seen.append((label, keep(d, label))) or seen[-1][1])
    got = sharding.shard(df, 4).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 2500 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    rows = dict(seen)["shard-rows"]
    buckets = rows.filter("doc_id IS NULL").groupBy((F.pmod(F.xxhash64("doc_id", "group_key", "_u"), F.lit(16))).alias("b")).count().collect()
    assert len(buckets) == 16 and max(r["count"] for r in buckets) < 400
