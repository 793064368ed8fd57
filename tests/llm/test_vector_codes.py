from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from lodestar.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, key string, entry string"


def floors(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = next((len(r[1]) for r in kept if r[1] and len(r[1]) % parts == 0), None)
    kept = [(i, floors(v), label) for i, v, label in kept if len(v) == size]
    width = (size or 0) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign(c, p):
        return min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [assign(c, p)[1] for c in cut]
            fresh = [list(e) for e in books[p]]
            for i in set(own):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == i]
                fresh[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
            books[p] = fresh
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[assign(c, p) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    per = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        per[label] = per.get(label, 0) + e
    return sorted([(i, "".join(f"{j:02x}" for _, j in f), e, per[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)], key=repr)


def rows_of(seed, n=120):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(8)], rnd.choice([None, 0, 1, 2])) for i in rnd.sample(range(-50, 1000), n)]
    rows += [(2000 + i, [round(rnd.random() * 2) / 256 for _ in range(8)], 7) for i in range(30)]  # ties
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], 1), (None, rows[6][1], None)]
    rows += [(3001, None, 1), (3002, [0.0] * 7 + [None], 1), (3003, [0.0] * 7 + [math.nan], 1), (3004, [math.inf] + [0.0] * 7, 1), (-99, [1.0, 2.0], 1), (-98, [], 1)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_codes_are_those_of_all_pairs(spark):
    for seed, entries, rounds in ((1, 16, 2), (2, 5, 0), (3, 256, 1)):
        rows = [r for r in rows_of(seed) if r[0] != -99]
        got = V.compress(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA), parts=4, entries=entries, rounds=rounds)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 4, entries, rounds)


def test_rows_of_another_length_take_no_part(spark):
    rows = [*rows_of(4), (-100, [0.5] * 4, 1), (9000, [0.25] * 4, 1), (9001, [0.125] * 4, None)]
    got = V.compress(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA), parts=4, entries=16)
    assert sorted(r.vec_id for r in got.collect()) == [-100, 9000, 9001]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 4, 16, 2)


def test_empty_table(spark):
    assert V.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.compress(spark.createDataFrame([(1, None, 1, "", "", "")], SCHEMA)).collect() == []


def test_huge_components_are_held(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 16, 1, "", "", "") for i in range(4)]
    got = V.compress(spark.createDataFrame(rows, SCHEMA), entries=1, rounds=0).collect()
    assert sorted(r.error for r in got) == [0, 0, 16 * (1 << 25) ** 2, 16 * (1 << 25) ** 2]


def test_annuli_hold_the_nearest_and_leave_most_out():
    rng = np.random.default_rng(5)
    for spread in (1, 40, 4000):
        x, entries = rng.integers(-spread, spread + 1, (3000, 4)), rng.integers(-spread, spread + 1, (64, 4))
        entries[10], entries[20] = entries[30], entries[30]
        all_ = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        index, least, pairs = V.nearest(x, entries)
        assert (index == all_.argmin(axis=1)).all() and (least == all_.min(axis=1)).all()
        assert pairs < 0.85 * all_.size or spread == 1
    index, least, pairs = V.nearest(np.array([[1000, 0]]), np.array([[k, 0] for k in range(0, 6400, 100)]))
    assert (index[0], least[0]) == (10, 0) and pairs == 1
