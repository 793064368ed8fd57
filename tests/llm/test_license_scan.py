from __future__ import annotations

import random
import re

import pytest

from lodestar.llm import license_scan as ls

SCHEMA = "doc_id long, text string, labels string, score double"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_scan_against_brute_force(spark):
    rnd = random.Random(8)
    bits = ["MIT", "License", "license.", "Apache", "general", "PUBLIC", "gnu", "é", "x9", "--", "\x00", "mit-license", "K", "licenses", "\n"]
    texts = [None, "", "license", "mit license", "a " * 30_000 + "mit\nlicense"] + [" ".join(rnd.choices(bits, k=rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(ls.scan_licenses(df).collect())
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("GNU  Lesser General\nPublic License v2.1", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("released under CC BY-NC-SA 4.0 and the MIT licence", {"cc-by-nc-sa", "mit"}),
        ("see https://www.gnu.org/licenses/gpl-3.0.html", {"gpl-3.0"}),
        ("Permission is hereby granted,\n free of charge, to any person obtaining a copy", {"mit"}),
        ("All  Rights\tReserved", {"proprietary"}),
        ("a plain sentence about a permit to drive", set()),
    ],
)
def test_signatures(text, labels):
    found = ls.Scanner().detections(text.encode().lower())
    assert {r.label for *_, r in found} == labels


def example(parsed):
    """A text that a parsed pattern matches, optional parts left out."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else chr(arg[0][1][0]) if str(arg[0][0]) == "RANGE" else " "
        elif name == "ANY":
            out += "x"
        elif name == "BRANCH":
            out += example(arg[1][0])
        elif name == "SUBPATTERN":
            out += example(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += example(arg[2]) * arg[0]
    return out


def test_the_prefilter_loses_no_detection():
    own = ls.rules()
    filtered = ls.Scanner(own)
    free = ls.Scanner([ls.Rule(r.label, b"", r.pattern, r.priority, r.confidence) for r in own])
    names = ["expat license", "x11 license", "asl 2.0", "epl-2.0", "mpl-1.1", "psf license", "gfdl", "odbl", "internet systems consortium license", "open rail license", "lgplv3", "lgplv2.1"]
    for r in own:
        text = example(re._parser.parse(r.pattern.pattern, r.pattern.flags))
        assert r.pattern.search(text.encode()), text
        assert r.keyword and r.keyword in text.encode()
        names.append(text)
    for text in names:
        found = [[(a, b, r.label) for a, b, r in s.detections(text.encode())] for s in (filtered, free)]
        assert found[0] == found[1] != [], text


def test_suppression_by_priority_and_containment():
    def rule(label, pattern, priority):
        return ls.Rule(label, b"a", re.compile(pattern), priority, 0.5)

    s = ls.Scanner([rule("long", b"a b c d", 1), rule("inner", b"b c", 1), rule("strong", b"c", 2), rule("over", b"c d e", 1)])
    assert [(a, b, r.label) for a, b, r in s.detections(b"a b c d e")] == [(0, 7, "long"), (4, 5, "strong"), (4, 9, "over")]


def test_there_are_hundreds_and_the_filter_loses_none():
    own = ls.rules()
    assert len(own) > 300
    assert all(b" " not in r.keyword for r in own)


def test_empty(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suppression_against_brute_force():
    """Random rules over random texts: a find goes if one ranked before it, kept, holds it."""
    rnd = random.Random(5)
    for _ in range(150):
        own = []
        for k in range(rnd.randint(1, 12)):
            a, n = rnd.randrange(4), rnd.randint(1, 4)
            p = rb"[ab]?".join(rnd.choice([b"a", b"b", b"c"]) for _ in range(n)) + (b"", b"c*", b"b+")[a % 3]
            own.append(ls.Rule(f"r{rnd.randrange(6)}", b"", re.compile(p), rnd.randint(1, 5), 0.5))
        text = bytes(rnd.choices(b"abc", k=rnd.randint(0, 60)))
        found = [(m.start(), m.end(), r) for r in own for m in r.pattern.finditer(text)]
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        kept = []
        for x in found:
            if not any(a <= x[0] and x[1] <= b for a, b, _ in kept):
                kept.append(x)
        want = sorted((a, b, r.label, r.priority) for a, b, r in kept)
        assert sorted((a, b, r.label, r.priority) for a, b, r in ls.Scanner(own).detections(text)) == want


def test_rule_detections_against_every_rule_tried_everywhere(spark):
    """The given documents: each rule without its keyword, suppression pair by pair."""
    own = ls.rules()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in ls.scan_licenses(docs).collect()}
    some = 0
    for doc_id, text in docs.collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
        found = [(m.start(), m.end(), r) for r in own for m in r.pattern.finditer(low)]
        kept = {
            (a, b, r.label, r.confidence)
            for a, b, r in found
            if not any(c <= a and b <= d and (q.priority > r.priority or q.priority == r.priority and (d - c > b - a or q.label < r.label)) for c, d, q in found)
        }
        assert {tuple(x) for x in got[doc_id].detections} == kept
        assert set(got[doc_id].labels.split(",")) - {""} == {x[2] for x in kept} | (set(got[doc_id].base_labels.split(",")) - {""})
        some += bool(kept)
    assert some


def test_very_many_mentions_take_linear_time(spark):
    import time

    text = "licensed under the mit license. see the apache license, version 2.0 " * 50_000
    began = time.time()
    found = ls.Scanner().detections(text.encode())
    assert time.time() - began < 10
    assert len(found) == 100_000
    rows = [(1, text, "", 0.0), (1, text, "", 0.0), (None, "mit license", "", 0.0), (None, None, "", 0.0)]
    got = ls.scan_licenses(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_base", "labels").collect()
    assert sorted([(r.doc_id or 0, r.n_base) for r in got]) == [(0, 0), (0, 1), (1, 100_000), (1, 100_000)]
