from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from lodestar.llm import lm_scoring

SCHEMA = "doc_id long, text string, score double, word string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def code_length(text, counts, order=3):
    """PPM with method C and exclusion, walked symbol by symbol from the definition."""
    b = b"\xff" * order + lower(text).encode() + b"\xff"
    total = 0.0
    for i in range(order, len(b)):
        gone = set()
        for k in range(order, -1, -1):
            c = {s: n for s, n in counts.get(b[i - k : i], {}).items() if s not in gone}
            seen = len(counts.get(b[i - k : i], {}))
            if not seen:
                continue
            n = sum(c.values())
            if b[i] in c:
                total += math.log10(c[b[i]] / (n + seen))
                break
            total += math.log10(seen / (n + seen))
            gone |= counts[b[i - k : i]].keys()
        else:
            total -= math.log10(256 - len(gone))
    return total


@pytest.fixture
def docs(spark):
    rnd = random.Random(1)
    words = ["Über", "the", "The", "a", "tion", "of", "ΩΩ", "x\x00y"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 40))), 1.0, "clash") for i in range(120)]
    rows += [(500, None, 0.0, ""), (501, "", 0.0, ""), (None, "a \t\n of", 0.0, ""), (7, rows[7][1], 1.0, ""), (509, "never " * 3000, 0.0, ""), (510, "日本 qqq", 0.0, "")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_scores(docs):
    rows, df = docs
    got = sorted(lm_scoring.score(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    train = [t for i, t, *_ in rows if not out(i)]
    words = Counter(w for t in train for w in [*lower(t).encode().split(), "END"])
    n, v = words.total(), len(words)
    grams = {}
    for t in train:
        b = b"\xff\xff\xff" + lower(t).encode() + b"\xff"
        for i in range(3, len(b)):
            for k in range(4):
                grams.setdefault(b[i - k : i], Counter())[b[i]] += 1
    want = []
    for i, t, *_ in rows:
        w = [*lower(t).encode().split(), "END"]
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, out(i), len(w), sum(x in words for x in w), n, base, code_length(t, grams)))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    for g, x in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == x[:5]
        assert g.base_score == pytest.approx(x[5], rel=1e-9)
        assert g.score == pytest.approx(x[6], rel=1e-4)


def test_bounds_leave_word_counts_exact(docs, monkeypatch):
    """Few heavy words and few contexts sent: neither the words' scores nor the texts' change."""
    _, df = docs
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    full = sorted(lm_scoring.score(df).collect(), key=key)
    monkeypatch.setattr(lm_scoring, "HEAVY", 10)
    monkeypatch.setattr(lm_scoring, "SENT_CONTEXTS", 12)
    small = sorted(lm_scoring.score(df).collect(), key=key)
    assert [r.base_score for r in small] == pytest.approx([r.base_score for r in full])
    assert [r.n_known for r in small] == [r.n_known for r in full]
    assert all(r.score < 0 for r in small)
    assert [r.score for r in small] == pytest.approx([r.score for r in full], rel=1e-5)


@pytest.mark.parametrize("bound", [("SENT_CONTEXTS", 12), ("SENT_CONTEXTS", 0), ("SENT_GRAMS", 40)])
def test_contexts_beyond_the_trie_score_alike(docs, monkeypatch, bound):
    _, df = docs
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score)
    full = sorted(lm_scoring.score(df).collect(), key=key)
    monkeypatch.setattr(lm_scoring, *bound)
    few = sorted(lm_scoring.score(df).collect(), key=key)
    assert [r.score for r in few] == pytest.approx([r.score for r in full], rel=1e-5)


def test_all_contexts_count(spark):
    """More contexts than 131,072, each text with its own: every one is scored as it was trained."""
    rnd = random.Random(6)
    rows = [(i, "".join(chr(rnd.randrange(0x10000, 0x110000)) for _ in range(60))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grams = {}
    for i, t in rows:
        if not out(i):
            b = b"\xff\xff\xff" + lower(t).encode() + b"\xff"
            for j in range(3, len(b)):
                for k in range(4):
                    grams.setdefault(b[j - k : j], Counter())[b[j]] += 1
    assert sum(len(c) == 3 for c in grams) > 1 << 17
    got = {r.doc_id: r.score for r in lm_scoring.score(df).filter("doc_id % 100 = 0").collect()}
    for i, t in rows[::100]:
        assert got[i] == pytest.approx(code_length(t, grams), rel=1e-4)


def test_empty(spark):
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
