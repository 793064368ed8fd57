from __future__ import annotations

import random
import re
from collections import Counter

from lodestar.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, kept string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    symbols = sum(c in "#*$%&|<>" for c in t)
    dup = len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    stop = sum(x.lower() in qr.STOP_WORDS for x in w)
    kept = not failed and 2 <= chars / len(w) <= 15 and symbols / chars <= 0.1 and stop / len(w) >= 0.005 and dup / len(lines) <= 0.5
    return len(w), chars, symbols, dup, len(hit), failed, kept


def test_against_brute_force(spark):
    rnd = random.Random(9)
    words = ["the", "of", "été", "𝔘x", "a", "##", "$&", "longish", "Was", "x\x00", " ", "qqq"]
    texts = [None, "", " \t\n", "one", "a b a b a b", "x " * 20_000, ("z" * 30_000 + " ") * 60]
    texts += [rnd.choice([" ", "\n", "\t "]).join(rnd.choices(words, k=rnd.randint(0, 120))) for _ in range(150)]
    texts += ["\n".join(rnd.choices(["the line of it", "another line", "", " "], k=30)) for _ in range(10)]
    texts += [" ".join(f"word{rnd.randrange(10**6)}" for _ in range(60)) + " the of the"] * 2
    texts += [" ".join(f"word{j}" for j in range(20_000)) + " the of" * n for n in (1, 60)]  # a ratio, not a count
    assert not brute(texts[-2])[-1] and brute(texts[-1])[-1]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = sorted(qr.apply_rules(df, "doc_id").collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts, strict=True):
        assert tuple(r[c] for c in cols) == brute(t)
    kept = qr.filter_documents(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if brute(t)[-1]]
    assert kept.filter("kept = 'clash'").count() == kept.count() > 0


def test_the_table_can_be_changed_and_is_native(spark):
    df = spark.createDataFrame([(1, "the of " * 10, "", "")], SCHEMA)
    assert qr.apply_rules(df, "doc_id", rules=()).first().kept is False
    plan = qr.apply_rules(df, "doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"word{i} the" for i in range(60))
    rows = [(None, text, "a", "x"), (None, None, "b", "x"), (1, text, "c", "x"), (1, text, "c", "x"), (1, "short", "d", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted([(r.doc_id, r.n_words, r.kept) for r in qr.apply_rules(df, "doc_id").collect()], key=repr)
    assert got == sorted([(None, 120, True), (None, 0, False), (1, 120, True), (1, 120, True), (1, 1, False)], key=repr)
    assert sorted(r["kept"] for r in qr.filter_documents(df).collect()) == ["a", "c", "c"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert qr.apply_rules(df, "doc_id").collect() == [] and qr.filter_documents(df).collect() == []
