from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from lodestar.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(sizes):
    """Repeat: share what is left among open sources by weight, close those above twice their size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


@pytest.fixture
def rows():
    rnd = random.Random(12)
    rows = []
    for i in range(3000):
        source = rnd.choice(["b", "B", "é", "", None, "tiny", "𝔘", "hot", "hot", "hot"])
        if source == "tiny" and rnd.random() < 0.8:
            continue
        rows.append((i, "w " * int(rnd.paretovariate(0.8) % 3000), source, "clash"))
    rows += [(5000, None, "nothing", ""), (5001, "", "nothing", ""), (5002, "x " * 9000, "one", ""), (5003, "  a", None, "")]
    return rows


def test_targets_epochs_and_reruns(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split(" ")) - 1 if (t or "").endswith(" ") else len([x for x in (t or "").split(" ") if x]) for i, t, *_ in rows}
    assert {r.doc_id: r.size for r in got} == size
    per, taken, counts = Counter(), Counter(), defaultdict(list)
    for r in got:
        per[r.source] += r.size
        taken[r.source] += r.taken
        counts[r.source].append(r.times)
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(per)
    for r in got:
        assert r.source_size == per[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in per:
        largest = max(r.size for r in got if r.source == s)
        assert abs(taken[s] - want[s]) <= max(1, largest / 2), s
        if len(counts[s]) > 30:
            assert abs(taken[s] - want[s]) <= 0.01 * want[s], s
        assert max(counts[s]) - min(counts[s]) <= 1  # complete epochs come first
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_sources_are_filled_until_nothing_fits(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        left = own[0].target - sum(r.taken for r in own)
        least = min(r.times for r in own)
        # a document of one epoch less than others is longer than what is left
        assert left >= -1e-6
        if any(r.times > least for r in own if r.size):
            assert all(r.size > left for r in own if r.times == least and r.size)


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "word " * (60 if i % 2 else 40), s, "") for i in range(4000) for s in ("a", "b", "c")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).filter("source = 'b'").collect()
    drawn = Counter(r.size for r in got if r.times == max(x.times for x in got))
    assert drawn[60] > 1.2 * drawn[40]


def test_documents_follow_the_plan(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    times = {r.doc_id: r.times for r in mixing.mix(df).collect()}
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in times.items() if v})


def test_repeated_rows_share_their_fate(spark):
    rows = [(i % 50, "w " * (i % 50 + 1), "s" if i % 2 else "t", "") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id, r.source].add(r.times)
    assert len(got) == 200 and all(len(x) == 1 for x in by.values())


def test_no_python_and_empty(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert "Python" not in mixing.sizes(df)._jdf.queryExecution().toString()
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mix_documents(df.limit(0)).collect() == []
    none = spark.createDataFrame([(1, None, None, ""), (2, " ", "a", "")], SCHEMA)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(none).collect()) == [(1, 0), (2, 0)]


def test_null_ids_and_long_texts(spark):
    rows = [(None, "a b c", "s", ""), (None, "a b c", "s", ""), (None, "d e", "t", ""), (1, "w " * 50_000, "s", ""), (2, None, None, "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.size for r in got)) == [0, 2, 3, 3, 50_000] and all(r.taken % max(1, r.size) == 0 for r in got)
    assert len({r.times for r in got if r.doc_id is None and r.source == "s"}) == 1  # rows of null ids share their fate
    assert sum(r.taken for r in got if r.source == "s") <= next(r.target for r in got if r.source == "s") + 1e-6
