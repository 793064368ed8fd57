"""Binary corpora and raw vector files."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.sources import binary as B

DOCS = "doc_id string, text string, title string"


def documents(n=60):
    rnd = random.Random(n)
    rows = [(str(i), "".join(rnd.choices("ab é\n", k=rnd.choice([0, 5, 99, 100, 101, 4000]))), rnd.choice(["", "t", "long title " * 20])) for i in range(n)]
    return [*rows, ("null", None, None), ("", "no id", ""), ("ü" * 30, "x" * 300_000, "")]


def plain(rows):
    return sorted((i, t or "", h or "") for i, t, h in rows)


@pytest.fixture
def corpus(spark, tmp_path):
    at = str(tmp_path / "corpus")
    B.register(spark)
    spark.createDataFrame(documents(), DOCS).repartition(3).write.format("lodestar_corpus").mode("append").save(at)
    return at


@pytest.mark.parametrize("split", [1, 5000, 1 << 30])
def test_records_come_back(spark, corpus, split):
    found = spark.read.format("lodestar_corpus").option("split", split).load(corpus)
    assert plain(found.collect()) == plain(documents())
    assert found.rdd.getNumPartitions() == (63 if split == 1 else 3 if split > 5000 else found.rdd.getNumPartitions())


def test_records_are_aligned_and_deflated(spark, corpus):
    parts = B._parts(corpus)
    size = sum(os.path.getsize(f"{corpus}/{p['name']}.bin") for p in parts)
    assert size == sum(p["bytes"] for p in parts) and size % 16 == 0 and size < 60_000
    assert sum(p["text_bytes"] for p in parts) == sum(len((t or "").encode()) for _, t, _ in documents())
    assert sum(p["deflated"] for p in parts) == sum(len((t or "").encode()) >= 100 or len(h or "") >= 100 for _, t, h in documents())


def test_ids_are_filtered_before_texts_are_inflated(spark, corpus, monkeypatch):
    found = spark.read.format("lodestar_corpus").load(corpus).filter(F.col("doc_id").isin("3", "17", "none"))
    assert sorted(r.doc_id for r in found.collect()) == ["17", "3"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan
    inflated = []
    monkeypatch.setattr(B.zlib, "decompress", lambda x: inflated.append(1) or b"")
    reader = B.CorpusReader(corpus, 1 << 30)
    assert list(reader.pushFilters([B.EqualTo(("doc_id",), "3"), B.EqualTo(("title",), "t")])) == [B.EqualTo(("title",), "t")]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1 and len(inflated) <= 2


def test_truncated_files_give_whole_records(spark, corpus):
    part = max(B._parts(corpus), key=lambda p: p["records"])
    at = f"{corpus}/{part['name']}.bin"
    offsets = np.fromfile(f"{corpus}/{part['name']}.idx", "<u8")
    every = {r.doc_id for r in spark.read.format("lodestar_corpus").load(corpus).collect()}
    for cut, lost in ((int(offsets[-1]) + 5, 1), (int(offsets[3]), len(offsets) - 3), (0, len(offsets))):
        os.truncate(at, cut)
        for split in (1, 1 << 30):
            left = {r.doc_id for r in spark.read.format("lodestar_corpus").option("split", split).load(corpus).collect()}
            assert left < every and len(every - left) == lost


def test_append_overwrite_and_failure(spark, corpus):
    more = spark.createDataFrame([("new", "text", "")], DOCS)
    more.write.format("lodestar_corpus").mode("append").save(corpus)
    assert spark.read.format("lodestar_corpus").load(corpus).count() == 64
    before = sorted(os.listdir(corpus))
    broken = spark.range(100).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") > 97, F.raise_error(F.lit("no"))).otherwise("x").alias("text"), F.lit("").alias("title"))
    with pytest.raises(Exception, match="no"):
        broken.repartition(2).write.format("lodestar_corpus").mode("append").save(corpus)
    assert sorted(os.listdir(corpus)) == before
    more.write.format("lodestar_corpus").mode("overwrite").save(corpus)
    assert [tuple(r) for r in spark.read.format("lodestar_corpus").load(corpus).collect()] == [("new", "text", "")]
    assert len(os.listdir(corpus)) == 1 + 2 * len(B._parts(corpus))


def test_empty_corpus(spark, tmp_path):
    at = str(tmp_path / "none")
    spark.createDataFrame([], DOCS).write.format("lodestar_corpus").mode("append").save(at) if B.register(spark) else None
    assert spark.read.format("lodestar_corpus").load(at).collect() == []


@pytest.mark.parametrize("split", [1, 100, 1 << 30])
def test_raw_vectors(spark, tmp_path, split):
    B.register(spark)
    x = np.random.default_rng(1).normal(size=(50, 6)).astype("<f4")
    at = str(tmp_path / "v.f32")
    x.tofile(at)
    found = spark.read.format("lodestar_vectors").option("n", 50).option("split", split).load(at)
    got = sorted((r.vec_id, r.embedding) for r in found.collect())
    assert [i for i, _ in got] == list(range(50)) and (np.array([v for _, v in got], "<f4") == x).all()
    folder = str(tmp_path / "folder")
    found.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").write.format("lodestar_vectors").mode("append").save(folder)
    again = sorted((r.vec_id, r.embedding) for r in spark.read.format("lodestar_vectors").option("split", split).load(folder).collect())
    assert again == got
    with pytest.raises(Exception, match="no 7 vectors"):
        spark.read.format("lodestar_vectors").option("n", 7).load(at).collect()
