from __future__ import annotations

import random

import pytest

from lodestar.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, n_shingles string, component_id string, v string"


def shingles(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=85):
    """(doc_id, n, component) of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        own = least.setdefault(find(i), doc)
        least[find(i)] = doc if own is None or (doc is not None and doc < own) else own
    return sorted(((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def made(seed, groups=25):
    """Documents with passages that many share, chains of edited copies, copies, short and odd texts."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Ab", "ab"]
    common = [" ".join(rnd.choices(vocab, k=60)) for _ in range(3)]
    texts = [None, "", " \n\t", "One", "one", "ONE two", "one two three", "one two three four", "x " * 3000]
    for _ in range(groups):
        w = rnd.choices(vocab, k=rnd.choice([6, 12, 40, 120]))
        if rnd.random() < 0.7:
            w += rnd.choice(common).split()
        texts.append(" ".join(w))
        for _ in range(rnd.randint(0, 7)):
            w = list(w)
            for _ in range(rnd.randint(1, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append("\n".join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    texts += rnd.choices(texts, k=12)
    rows = list(zip(rnd.sample(range(5000), len(texts)), texts, strict=True))
    return [*rows, rows[-1], (None, texts[10]), (None, None), (None, texts[9]), (rows[9][0], texts[20])]


@pytest.mark.parametrize(("rare", "common", "hot"), [(32, 1024, 20_000), (2, 5, 3), (3, 2000, 4)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, rare, common, hot):
    monkeypatch.setattr(J, "RARE", rare)
    monkeypatch.setattr(J, "COMMON", common)
    monkeypatch.setattr(J, "HOT", hot)
    rows = made(rare)
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)
    got = J.join_documents(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_tokens_do_not_meet_in_a_broadcast_only(spark, monkeypatch):
    monkeypatch.setattr(J, "_SENT", 1)
    rows = made(5, 12)
    got = J.join_documents(spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert J.join_documents(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("percent", [50, 70, 85, 100])
def test_prefixes_of_similar_sets_share_a_signature(percent):
    rnd = random.Random(percent)
    level = {}
    for _ in range(1500):
        n = rnd.choice([1, 2, 3, 5, 9, 15, 16, 17, 60, 64, 70, 250])
        a = set(rnd.sample(range(1, 1 << 30), n))
        b = set(rnd.sample(sorted(a), rnd.randint(max(1, n * percent // 100), n)))
        b |= {rnd.randrange(1, 1 << 30) for _ in range(rnd.randint(0, n // 6))}
        if 100 * len(a & b) < percent * len(a | b):
            continue
        weights = rnd.choice([(1, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 1, 1), (0, 0, 1, 5)])
        level = {t: rnd.choices(range(4), weights)[0] for t in a | b}
        found = []
        for s in (a, b):
            order = sorted(s, key=lambda t: (level[t], t))
            found.append(J.signatures(len(s), [level[t] for t in order], order, percent))
        assert found[0].keys() & found[1].keys(), (sorted(a), sorted(b))
