from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import decontamination as dc

DOCS = "doc_id long, text string, item_id long, score double"


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_the_full_table():
    rnd = random.Random(2)
    for _ in range(200):
        a = [rnd.randrange(6) for _ in range(rnd.randint(1, 15))]
        b = [rnd.randrange(6) for _ in range(rnd.randint(0, 25))]
        score, s, e = dc.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == smith_waterman(a, b)
        if score:
            assert smith_waterman(a, b[s:e]) == score


@pytest.fixture
def tables(spark):
    rnd = random.Random(4)
    vocab = [f"word{i}" for i in range(500)] + ["the", "of", "and", "été", "ß"] * 40
    some = lambda n: rnd.choices(vocab, k=n)
    items = [some(rnd.randint(20, 45)) for _ in range(30)]
    stock = some(12)
    rows, planted = [(900, None, 0, 0.0), (901, "", 0, 0.0), (902, "of the " * 4000, 0, 0.0)], set()
    for d in range(200):
        text = some(rnd.randint(0, 300)) + stock * (d % 3 == 0)
        if d % 4 == 0:
            i = rnd.randrange(len(items))
            copy = list(items[i])
            if d % 8 == 0:
                for _ in range(len(copy) // 8):
                    copy[rnd.randrange(len(copy))] = "edited"
                copy.insert(3, "extra")
                del copy[7]
            at = rnd.randint(0, len(text))
            text = text[:at] + copy + text[at:]
            planted.add((d, i))
        rows.append((d, ", ".join(w.title() if rnd.random() < 0.2 and w.isascii() else w for w in text), 5, 1.0))
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(77, None), (78, ""), (79, "two words"), (80, " ".join(stock) + " " + " ".join(some(30)))]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(bench, "item_id long, text string"), planted, rows, bench


@pytest.mark.parametrize("block", [16 << 20, 2000])
def test_planted_copies_and_clean_documents(tables, block, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    docs, bench, planted, rows, items = tables
    got = dc.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted
    text, item = {r[0]: words(r[1]) for r in rows}, {i: words(t) for i, t in items}
    for r in got[:10]:
        assert r.score == smith_waterman(item[r.item_id], text[r.doc_id]) / (2 * len(item[r.item_id]))
        assert smith_waterman(item[r.item_id], text[r.doc_id][r.first_word : r.last_word + 1]) / (2 * len(item[r.item_id])) == r.score
    kept = dc.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r in rows} - {d for d, _ in planted})


def test_rows_do_not_depend_on_the_block(spark, tables, monkeypatch):
    docs, bench, _, _, items = tables
    again = bench.unionByName(bench.filter("item_id < 3")).unionByName(spark.createDataFrame([(500, items[0][1]), (None, items[1][1])], bench.schema))
    whole = sorted(map(tuple, dc.leaks(docs, again).collect()), key=repr)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 400)
    assert sorted(map(tuple, dc.leaks(docs, again).collect()), key=repr) == whole
    one = {r[0] for r in whole if r[1] == 0}
    assert len(one) and sum(r[1] == 0 for r in whole) == 2 * len(one) and {r[0] for r in whole if r[1] == 500} == one
    alone = sorted(map(tuple, dc.leaks(docs, bench.filter("item_id = 0")).collect()))
    assert alone == sorted({r for r in whole if r[1] == 0})
    assert all(0 < r[3] <= len(words(items[0][1])) - 1 for r in alone)


def test_empty(spark, tables):
    docs, bench, *_ = tables
    assert dc.leaks(docs.limit(0), bench).collect() == []
    assert dc.leaks(docs, bench.limit(0)).collect() == []
    assert dc.clean_documents(docs, bench.limit(0)).count() == docs.count()


def test_words():
    own, first = dc.words_of(pa.array(["A b,B", None, "a\x00É9"]))
    assert own.to_pylist() == [b"a", b"b", b"b", b"a", "É9".encode()] and first.tolist() == [0, 3, 3, 5]
    known = dc.Items([1], ["b 9 a"]).numbers(own)
    assert known.tolist() == [2, 0, 0, 2, -1]


def test_partial_and_much_edited_copies(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows, items = [], []
    for i in range(60):
        item = rnd.sample(vocab, rnd.randint(9, 45))
        copy = list(item)
        for at in rnd.sample(range(len(copy)), round(len(copy) * (0.2 + 0.1 * (i % 2)))):
            copy[at] = rnd.choice(["edited", "changed", "other"])
        if i % 3 == 0:  # the first part only
            copy = item[: len(item) * 3 // 5]
        if i % 5 == 0:  # a gram, then words put between
            copy = item[:3] + [x for w in item[3:] for x in ([w, "more"] if rnd.random() < 0.4 else [w])]
        items.append((i, " ".join(item)))
        rows.append((i, " ".join(rnd.choices(vocab, k=60) + copy + rnd.choices(vocab, k=60))))
    expected = set()
    for d, text in rows:
        for i, item in items:
            a, b = words(item), words(text)
            if len(set(a) & set(b)) >= dc.THRESHOLD * len(set(a)) / 2 and smith_waterman(a, b) / (2 * len(a)) >= dc.THRESHOLD:
                expected.add((d, i))
    assert len(expected) > 50
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()} == expected
    assert {r.doc_id for r in dc.clean_documents(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in expected}


def test_no_alignment_at_the_threshold_is_lost():
    """All pairs of random items and texts, most near the threshold, against the full table."""
    rnd = random.Random(21)
    common = [f"c{i}" for i in range(12)]
    items = [[rnd.choice(common) if rnd.random() < 0.5 else f"i{i}-{j}" for j in range(rnd.randint(3, 24))] for i in range(25)]
    texts = [rnd.choices(common, k=80)]
    for item in items:
        for kind in range(6):
            copy = []
            for j, w in enumerate(item):
                if kind == 0 and j % 3 == 1 or kind == 3 and rnd.random() < 0.35:
                    copy.append("edited")  # each third word: no three in a row are left
                elif kind == 1:
                    copy += [w, "put"][: 2 if j + 1 < len(item) else 1]  # a word between any two
                elif kind == 2 and rnd.random() < 0.3:
                    copy += rnd.choices(["put", *common], k=rnd.randint(0, 3))
                elif not (kind == 4 and rnd.random() < 0.3 or kind == 5 and j < len(item) // 2):
                    copy.append(w)
            texts.append(rnd.choices(common, k=5) + copy + rnd.choices(common, k=5))
    own = dc.Items(list(range(len(items))), [" ".join(w.replace("-", "x") for w in x) for x in items])
    got = {(d, i): score for d, i, score, *_ in own.leaks(pa.array([" ".join(w.replace("-", "x") for w in t) for t in texts]))}
    want = {(d, i): smith_waterman(x, t) / (2 * len(x)) for d, t in enumerate(texts) for i, x in enumerate(items)}
    want = {k: v for k, v in want.items() if v >= dc.THRESHOLD}
    assert got == want
    assert sum(v == dc.THRESHOLD for v in want.values()) > 10


def test_repeated_ids_null_ids_and_long_texts(spark):
    item = [f"w{i}" for i in range(20)]
    long = " ".join(["filler"] * 400_000 + item + ["filler"] * 1000)
    rows = [(1, " ".join(item)), (1, "clean"), (None, " ".join(item)), (None, "clean too"), (2, long), (3, " ".join(item[:3]) + " z" * 50)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item)), (5, " ".join(item)), (None, "x y z")], "item_id long, text string")
    assert sorted([r.doc_id or 0 for r in dc.leaks(docs, bench).collect()]) == [0, 0, 1, 1, 2, 2]
    assert sorted(r.text[:6] for r in dc.clean_documents(docs, bench).collect()) == ["clean", "clean ", "w0 w1 "]
