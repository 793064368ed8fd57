from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from test_quality_rules import brute as quality
from test_simhash import brute_components, brute_fingerprint

from lodestar.llm import mixing


def test_run_against_brute_force(spark, tmp_path):
    rnd = random.Random(21)
    vocab = ["the", "of", "la", "und"] * 20 + [f"word{i}" for i in range(900)]
    some = lambda n: " ".join(rnd.choices(vocab, k=n))
    items = [(i, some(30)) for i in range(5)]
    docs = [some(rnd.randint(40, 300)) for _ in range(150)]
    docs += [docs[i] for i in range(20)] + [docs[i] + " end" for i in range(20, 40)]
    docs += [some(60) + " " + items[i % 5][1] + " " + some(60) for i in range(10)] + ["## " * 80, "", None]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), "clash") for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "shard_id"]
    left = [r for r in rows if quality(r[1])[-1]]
    label = brute_components([brute_fingerprint(r[1]) for r in left])
    first = {}
    for k, r in enumerate(left):
        first.setdefault(label[k], r)
    left = sorted(first.values())
    whole = dict(items)
    clean = [r for r in left if not any(t in r[1] for t in whole.values())]
    assert len(left) - len(clean) == 10
    times = mixing.mix(spark.createDataFrame([r[:4] for r in clean], "doc_id long, text string, lang string, source string"))
    assert got == Counter({r.doc_id: r.times for r in times.collect() if r.times})
    shards = {}
    for r in out.collect():
        assert shards.setdefault(r.text, r.shard_id) == r.shard_id


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns


def test_null_ids_repeated_rows_and_long_texts(spark, tmp_path):
    rnd = random.Random(4)
    vocab = ["the", "of", "la", "und"] * 20 + [f"word{i}" for i in range(900)]
    t = [" ".join(rnd.choices(vocab, k=n)) for n in (80, 90, 100, 110, 40_000)]
    rows = [(1, t[0]), (1, t[0]), (1, t[3]), (None, t[1]), (None, t[1]), (None, t[2]), (7, t[1]), (8, t[4]), (8, t[4]), (None, None), (9, None), (None, "too short")]
    df = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, t[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = spark.createDataFrame(stage(spark, d, str(tmp_path)).collect(), df.schema)
        kept.append(sorted(((r.doc_id, t.index(r.text)) for r in d.collect()), key=repr))
    assert kept[0] == sorted([(i, t.index(x)) for i, x in rows if x in t], key=repr)
    assert kept[1] == sorted([(1, 0), (1, 3), (7, 1), (None, 2), (8, 4)], key=repr)  # one of each text, the smallest id
    assert kept[2] == sorted([(1, 0), (1, 3), (7, 1), (8, 4)], key=repr)  # the item itself is gone
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in out} <= {(i, t[j]) for i, j in kept[2]} and any(r.text == t[4] for r in out)
