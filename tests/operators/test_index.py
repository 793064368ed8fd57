"""The packed index: keys, blocks, the two rounds of a search, segments."""

from __future__ import annotations

import math
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions.text import tokens
from lodestar.operators import index as I
from lodestar.operators import results as R
from lodestar.operators import scoring as S
from lodestar.operators import segments as G

DOCS = "doc_id long, text string"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**62), max_size=6), max_size=8))
def test_packed_integers_come_back(runs):
    cut = np.cumsum([0, *map(len, runs)])
    packed = I.pack(np.array([x for r in runs for x in r], np.int64), cut)
    assert len(packed) == len(runs) and I.unpack(packed).tolist() == [x for r in runs for x in r]
    assert [I.unpack(packed.slice(i, 1)).tolist() for i in range(len(runs))] == runs


def hits(df):
    return sorted((r.qid, r.doc_id) for r in df.collect())


def test_an_index_of_other_rows_is_not_served(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(1, "omega alpha"), (2, "beta"), (3, "gamma"), (4, "delta")], DOCS).write.parquet(at)
    d, q = spark.read.parquet(at), spark.createDataFrame([(1, "omega"), (2, "sigma")], "qid long, text string")
    assert hits(S.bm25(d.union(spark.createDataFrame([(7, "omega one")], DOCS)), q)) == [(1, 1), (1, 7)]
    assert hits(S.bm25(d.union(spark.createDataFrame([(7, "sigma two")], DOCS)), q)) == [(1, 1), (2, 7)]


def test_an_index_of_another_filter_is_not_served(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(1, "C#1"), (2, "C#2"), (3, "c other"), (4, "x"), (5, "y"), (6, "z"), (7, "v"), (8, "w")], DOCS).write.parquet(at)
    d, q = spark.read.parquet(at), spark.createDataFrame([(1, "c")], "qid long, text string")
    assert hits(S.bm25(d.filter("text <> 'C#1'"), q)) == [(1, 2), (1, 3)]
    assert hits(S.bm25(d.filter("text <> 'C#2'"), q)) == [(1, 1), (1, 3)]


def test_only_bare_files_are_remembered(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a"), (2, "b")], DOCS).withColumn("other", F.lit("c")).write.parquet(at)
    d, read = spark.read.parquet(at), []
    keep = I.content_key
    monkeypatch.setattr(I, "content_key", lambda *x: read.append(1) or keep(*x))
    bare = d.select("doc_id", "text")
    for x in (bare, bare, bare.repartition(3), d.select("doc_id", F.col("text").alias("x")).select("doc_id", F.col("x").alias("text")), d):
        assert I._content_key(x) == keep(x)
    assert len(read) == 2  # two sets of columns
    for x in (d.withColumn("text", F.col("other")), d.select("doc_id", F.col("other").alias("text")), d.withColumn("text", F.lit("c")), d.withColumn("text", F.lit("d"))):
        for _ in range(2):
            assert I._content_key(x) == keep(x)
    assert len(read) == 7  # a column that is there twice is looked at each time
    for x in (d.filter("doc_id = 1"), d.limit(1), d.union(d), d.withColumn("text", F.upper("text")), d.distinct()):
        assert I._content_key(x) == keep(x)
    assert len(read) == 12
    spark.createDataFrame([(3, "a")], DOCS).withColumn("other", F.lit("c")).write.mode("append").parquet(at)
    again = spark.read.parquet(at).select("doc_id", "text")
    assert I._content_key(again) == keep(again) != I._content_key(d.limit(2))
    assert len(read) == 14


def zipf_texts(seed, n, words=300):
    rnd = random.Random(seed)
    vocab, weights = [f"w{i}" for i in range(words)], [1 / (i + 1) for i in range(words)]
    return [" ".join(rnd.choices(vocab, weights, k=rnd.choice([0, 3, 10, 60]))) for _ in range(n)], rnd


def brute(docs, queries, k, k1=1.2, b=0.75):
    counts = {i: Counter((t or "").lower().split()) for i, t in docs}
    n, avgdl = len(docs), sum(sum(c.values()) for c in counts.values()) / len(docs)
    df = Counter(w for c in counts.values() for w in c)
    out = []
    for qid, text in queries:
        q, scored = Counter(text.lower().split()), []
        for i, c in counts.items():
            dl = sum(c.values())
            s = sum(m * math.log((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * dl / avgdl)) for w, m in q.items() if c[w])
            if round(s, 6) > 0:
                scored.append((-round(s, 6), i))
        out += [(qid, i, -s) for s, i in sorted(scored)[:k]]
    return sorted(out)


def same(got, want):
    got = sorted((r.qid, r.doc_id, r.score) for r in got.collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


@pytest.mark.parametrize(("later", "asked", "size"), [(0.1, 200_000, 16), (0.0, 20, 8), (0.6, 30, 5), (1.0, 200_000, 7)])
def test_two_rounds_find_what_all_scores_give(spark, monkeypatch, later, asked, size):
    monkeypatch.setattr(S, "LATER", later)
    monkeypatch.setattr(S, "ASKED", asked)
    monkeypatch.setattr(I, "RANGE", size)
    texts, rnd = zipf_texts(size, 120)
    docs = list(enumerate([*texts, None, texts[3], texts[3]]))
    queries = [(i, " ".join(rnd.choices([f"w{j}" for j in range(320)], k=rnd.choice([1, 2, 6, 15])))) for i in range(25)] + [(90, ""), (91, "w0"), (92, "w0 w0 w1"), (93, texts[3] or "w5")]
    d, q = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(queries, "qid long, text string")
    for k in (1, 4, 200):
        same(S.bm25(d, q, k), brute(docs, queries, k))


def counted_blocks(monkeypatch):
    """Blocks that each round of searches reads."""
    seen, keep = [], S.by_range
    monkeypatch.setattr(S, "by_range", lambda rows: seen.append(rows[-1].count()) or keep(rows))
    return seen


def test_blocks_below_the_bound_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE", 8)
    texts = [f"common the of u{i}" + (" rare" if i in (100, 101) else "") for i in range(160)]
    d = spark.createDataFrame(list(enumerate(t + " pad" * (i % 7) for i, t in enumerate(texts))), DOCS).coalesce(1)
    d = d.union(spark.createDataFrame([(1000 + i, "filler") for i in range(400)], DOCS))
    seen = counted_blocks(monkeypatch)
    q = spark.createDataFrame([(1, "rare common")], "qid long, text string")
    assert [r.doc_id for r in S.bm25(d, q, 2).orderBy("rank").collect()] == [101, 100] or seen
    whole = G.kept(d).blocks
    rare, common = (whole.filter(F.col("term") == w).count() for w in ("rare", "common"))
    assert rare <= 2 and common >= 20
    assert seen[0] <= rare + common and sum(seen) <= 2 * (rare + common)
    monkeypatch.setattr(S, "LATER", 0.5)
    seen.clear()
    assert len(S.bm25(d, q, 2).collect()) == 2
    assert seen == [rare, 2 * rare]  # the common word's blocks are read in the rare word's ranges alone
    seen.clear()
    S.bm25(d, spark.createDataFrame([(1, "rare")], "qid long, text string"), 2).collect()
    rarer = sum(seen)
    seen.clear()
    S.bm25(d, spark.createDataFrame([(1, "common")], "qid long, text string"), 2).collect()
    assert rarer < sum(seen) / 5


def test_only_the_buckets_of_asked_words_are_read(spark):
    d = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(i, i + 40))) for i in range(100)], DOCS)
    blocks = G.kept(d).blocks
    bucket = spark.range(1).select(I.bucket_of(F.lit("t50"))).first()[0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own = blocks.filter(F.col("bucket").isin([bucket]) & F.col("term").isin(["t50"])).select("n")
        assert sum(r.n for r in own.collect()) == 40
        leaf = own._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read = leaf.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < read < blocks.count() / 8


def state(index):
    terms = {r.term: r.df for r in index.terms.collect()}
    return terms, tuple(index.stats.first()), sorted(map(tuple, index.postings.collect()), key=repr)


@pytest.mark.parametrize("fan", [0, 1, 4, 10**9])
def test_segments_are_an_index_built_anew(spark, monkeypatch, tmp_path, fan):
    monkeypatch.setattr(I, "RANGE", 16)
    monkeypatch.setattr(G.merge, "__defaults__", (fan,))
    texts, rnd = zipf_texts(fan % 97, 60, 80)
    now, path = dict(enumerate(texts)), str(tmp_path)
    G.save(spark.createDataFrame(list(now.items()), DOCS), path, "own")
    for turn in range(3):
        ids = rnd.sample(sorted(now), 6) + [1000 + 10 * turn + i for i in range(3)]
        new = {i: rnd.choice([None, "", *zipf_texts(turn + i, 1, 90)[0]]) for i in ids}
        G.upsert(spark.createDataFrame(list(now.items()), DOCS), spark.createDataFrame(list(new.items()), DOCS), path, "own")
        now |= new
        fresh = spark.createDataFrame(list(now.items()), DOCS)
        assert state(G.load(spark, path, "own")) == state(I.build(fresh))
    queries = [(i, " ".join(rnd.choices([f"w{j}" for j in range(80)], k=4))) for i in range(10)]
    same(S.bm25(G.load(spark, path, "own"), spark.createDataFrame(queries, "qid long, text string"), 5), brute(list(now.items()), queries, 5))
    n = len(G.segments(spark, f"{path}/own"))
    assert n == 4 if fan == 0 else n == 1 if fan > 4 else n >= 1
    before = state(G.load(spark, path, "own"))
    G.vacuum(spark, path, "own")
    assert state(G.load(spark, path, "own")) == before and len(G._all(spark, f"{path}/own")) == n


def test_index_of_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    G.save(none, str(tmp_path), "own")
    index = G.load(spark, str(tmp_path), "own")
    assert index.postings.collect() == [] and index.stats.first()[0] == 0
    assert S.bm25(index, spark.createDataFrame([(1, "a")], "qid long, text string")).collect() == []
    G.upsert(none, spark.createDataFrame([(1, "a a"), (2, "b"), (3, "c")], DOCS), str(tmp_path), "own")
    assert sorted(map(tuple, G.load(spark, str(tmp_path), "own").postings.collect())) == [(1, "a", 2, 2), (2, "b", 1, 1), (3, "c", 1, 1)]


def test_the_second_writer_of_a_segment_fails(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], DOCS)
    G.save(d, str(tmp_path), "own")
    G.save(spark.createDataFrame([(2, "b")], DOCS), str(tmp_path), "own")  # another session was first
    assert [r.doc_id for r in G.load(spark, str(tmp_path), "own").postings.collect()] == [1]
    with pytest.raises(FileExistsError):
        G._publish(I.parts_of(d, tokens), None, f"{tmp_path}/own", (0, 0))


def test_queries_asked_before_are_not_scored(spark, monkeypatch):
    scored = []

    def search(index, queries, k, k1=1.2):
        scored.append(queries.count())
        return S.bm25(index, queries, k, k1)

    d = spark.createDataFrame([(i, f"word{i} common {'rare' * (i == 3)}") for i in range(40)] + [(90, None), (91, uuid.uuid4().hex)], DOCS)  # kept by no session before
    q = spark.createDataFrame([(1, "rare word5"), (2, "no hits"), (3, None), (4, "rare word5")], "qid long, text string")
    ask = lambda docs, queries, **x: sorted(map(tuple, R.searched(search, docs, queries, 3, **x).collect()))
    want = sorted(map(tuple, S.bm25(d, q, 3).collect()))
    assert ask(d, q) == want and want and scored == [3]
    assert ask(d, q) == want and scored == [3]  # none again
    more = q.union(spark.createDataFrame([(5, "word7")], q.schema))
    assert ask(d, more) == sorted(map(tuple, S.bm25(d, more, 3).collect())) and scored == [3, 1]
    assert ask(d, q, k1=2.0) == sorted(map(tuple, S.bm25(d, q, 3, 2.0).collect())) and scored == [3, 1, 3]
    changed = d.withColumn("text", F.concat("text", F.lit(" word5")))
    assert ask(changed, q) == sorted(map(tuple, S.bm25(changed, q, 3).collect())) and scored == [3, 1, 3, 3]  # another corpus: all
