from __future__ import annotations

import random
import string

import numpy as np
import xxhash

from lodestar.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fingerprint(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = {i: i for i in range(len(fps))}
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                old = label[i]
                label = {k: label[j] if v == old else v for k, v in label.items()}
    return label


def test_fingerprints_and_components(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices(string.ascii_letters + "éß ", k=rnd.randint(1, 7))) for _ in range(300)]
    texts = [None, "", " \n\t", "One", "one two\tthree", "x " * 5000]
    for _ in range(60):
        w = rnd.choices(vocab, k=rnd.randint(30, 200))
        texts.append(" ".join(w))
        for _ in range(rnd.randint(0, 4)):
            w = list(w)
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append("\n".join(w))
    texts += [texts[6]] * 3
    ids = rnd.sample(range(1000), len(texts))
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in zip(ids, texts, strict=True)], SCHEMA)
    got = {r.doc_id: r for r in simhash.cluster(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp & (2**64 - 1) for i in ids] == fps
    label = brute_components(fps)
    least = {}
    for k, i in enumerate(ids):
        least[label[k]] = min(i, least.get(label[k], i))
    assert [got[i].component_id for i in ids] == [least[label[k]] for k in range(len(ids))]
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_one_of_each_with_null_and_repeated_ids(spark):
    rnd = random.Random(12)
    texts = [" ".join(rnd.choices([f"word{i}" for i in range(900)], k=80)) for _ in range(40)]
    rows = [(None, t) for t in texts[:20]]  # texts of their own
    rows += [(None, texts[0]), (None, texts[30]), (30, texts[30]), (31, texts[30])]  # copies; one with an id
    rows += [(7, texts[32]), (7, texts[33]), (7, texts[33]), (6, texts[34]), (7, texts[34])]  # an id of three texts
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(None, t) for t in texts[:20]] + [(30, texts[30]), (7, texts[32]), (7, texts[33]), (6, texts[34])]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, expected))


def near(fps, rnd, flips):
    for b in rnd.sample(range(64), flips):
        fps ^= 1 << b
    return fps


def test_no_link_is_lost(spark, monkeypatch):
    """All pairs at up to 4 bits, in chains, crowds and alone, also when anchors are salted."""
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:120]:
        for _ in range(3):
            f = near(f, rnd, rnd.randint(1, 6))
            fps.add(f)
    crowd = rnd.getrandbits(64)
    fps |= {near(crowd, rnd, rnd.randint(0, 3)) for _ in range(400)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    label = brute_components(fps)
    for hot, many in ((20_000, 1 << 30), (50, 1 << 30), (20_000, 0), (300, 0)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "MANY", many)
        links = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.link_fingerprints(df).collect()]
        assert all((u ^ v).bit_count() <= 4 for u, v in links)
        from lodestar.llm.components import components

        roots = {r.vertex & (2**64 - 1): r.root for r in components(simhash.link_fingerprints(df)).collect()}
        by = {}
        for k, f in enumerate(fps):
            by.setdefault(label[k], set()).add(roots.get(f, f))
        assert all(len(x) == 1 for x in by.values())
        assert len({next(iter(x)) for x in by.values()}) == len(by)


def test_empty(spark):
    assert simhash.cluster(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keys_that_hold_most_rows(spark, monkeypatch):
    from lodestar.llm import joins

    monkeypatch.setattr(joins, "SHARE", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(600)], "i long, k string")
    lookup = spark.createDataFrame([("hot", 1), *[(f"k{j}", j + 2) for j in range(39)], ("none", 0)], "k string, v long")
    got = joins.looked_up(rows, "k", lookup)
    assert sorted(got.columns) == ["i", "k", "v"]
    assert sorted((r.i, r.k, r.v) for r in got.collect()) == sorted((r.i, r.k, r.v) for r in rows.join(lookup, "k").collect())


def test_copies_of_one_text_hold_a_third(spark, monkeypatch):
    from lodestar.llm import joins

    monkeypatch.setattr(joins, "SHARE", 20)
    rnd = random.Random(2)
    rows = [(i, "the same text of all these copies" if i % 3 == 0 else " ".join(rnd.choices([f"v{j}" for j in range(500)], k=60))) for i in range(300)]
    got = {r.doc_id: r.component_id for r in simhash.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 300 and {got[i] for i in range(0, 300, 3)} == {0} and all(got[i] == i for i in range(300) if i % 3)


def test_one_row_repeated_holds_a_third(spark, monkeypatch):
    """Rows of one id and text, null ids too, leave one; every other text stays."""
    from lodestar.llm import joins

    monkeypatch.setattr(joins, "SHARE", 20)
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choices([f"u{j}" for j in range(500)], k=60))
    rows = [(None, "this row comes again and again", "x")] * 100 + [(7, "so does this one, with an id", "x")] * 100 + [(100 + i, text(), "y") for i in range(100)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _id string").repartition(4))
    assert got.columns == ["doc_id", "text", "_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(set(rows), key=repr)
