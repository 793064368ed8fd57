from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lodestar.llm import joins, substring_dedup

SCHEMA = "doc_id long, text string, key string, n long"


def brute(rows, window=50):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    order = [i if i is not None else 1 << 63 for i, *_ in rows]
    least = {}
    for o, w in zip(order, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(o, least.get(k, o))
    out = []
    for (i, *_), o, w in zip(rows, order, words, strict=True):
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < o:
                gone.update(range(j, j + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def rows():
    rnd = random.Random(11)
    vocab = [f"w{i}é" for i in range(400)]
    some = lambda n: rnd.choices(vocab, k=n)
    passages = [some(n) for n in (49, 50, 51, 73, 200)]
    rows = [(1000, None, "", 0), (1001, "", "", 0), (1002, "w " * 60, "", 0), (1003, "w\t" * 49, "", 0), (1004, "w  " * 3000, "", 0)]
    for i in range(80):
        w = some(rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 2)):
            w = w + rnd.choice(passages) + some(rnd.randint(0, 60))
        rows.append((i * 3 % 97, "\n ".join(w), "clash", 1))
    rows += [(2000, rows[30][1], "", 0), (2000, rows[30][1], "", 0), (rows[31][0], rows[31][1], "", 0), (None, rows[32][1], "", 0), (None, " ".join(some(200)), "", 0)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_against_brute_force(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in substring_dedup.dedupe(df).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_copies_beyond_a_share_of_all_rows(spark, monkeypatch):
    """Packed strings of many copies are looked up by a broadcast; so are those of a text that repeats itself."""
    monkeypatch.setattr(joins, "SHARE", 12)
    sent = []
    monkeypatch.setattr(joins, "materialise", lambda df, label: sent.append(substring_dedup.materialise(df, label)) or sent[-1])
    rnd = random.Random(5)
    copy = " ".join(f"c{rnd.randrange(900)}" for _ in range(70))
    rows = [(i, f"head{i} {copy} tail{i}", "", 0) for i in range(40)] + [(100 + i, "again and " * 400 + f"end{i}", "", 0) for i in range(3)]
    rows += [(200, " ".join(f"n{i}" for i in range(90)), "", 0)]
    got = [tuple(r) for r in substring_dedup.dedupe(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert sent[-1].count() > 0


def test_super_kmers_are_bounded():
    """Each window is in one super-k-mer of its minimiser, also where one word fills a text."""
    rnd = random.Random(2)
    words = np.array([7] * 500 + [rnd.randrange(50) for _ in range(300)] + [1, 2] * 100, np.uint64)
    first = np.array([0, 500, 800, 1000])
    mins, at, n = substring_dedup.super_kmers(words, first, 50, 8)
    assert n.min() >= 1 and n.max() <= 43
    covered = [(i, m) for m, a, k in zip(mins.tolist(), at.tolist(), n.tolist(), strict=True) for i in range(a, a + k)]
    assert [i for i, _ in covered] == [i for a, z in zip(first[:-1], first[1:], strict=True) for i in range(a, z - 49)]
    by_window = {}
    for i, m in covered:
        assert by_window.setdefault(tuple(words[i : i + 50].tolist()), m) == m


def test_empty(spark):
    assert substring_dedup.dedupe(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def thue_morse(n):
    w = b"a"
    while len(w) < n:
        w += w.translate(bytes.maketrans(b"ab", b"ba"))
    return w.decode()


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_cannot_tell_apart(spark, n):
    """Equal but for one word, whose letters are swapped: no window is repeated."""
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    shared = [f"s{i}" for i in range(49)]
    rows = [(1, " ".join([*shared, word]), "", 0), (2, " ".join([*shared, other]), "", 0), (3, " ".join([*shared, word]), "", 0)]
    got = sorted([tuple(r) for r in substring_dedup.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()], key=repr)
    assert got == brute(rows)
    assert [r[2] for r in got] == [0, 0, 50]


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    long = [f"v{rnd.randrange(5000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long), "", 0), (2, " ".join(["x", *long[1000:1100], "y"]), "", 0)]
    got = [tuple(r) for r in substring_dedup.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == brute(rows)
