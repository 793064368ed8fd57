from __future__ import annotations

import json
import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import contexts as C
from lodestar.operators import index as I
from lodestar.operators import metrics as M
from lodestar.operators import monitoring as N
from lodestar.operators import scoring as S
from lodestar.operators import segments as G
from lodestar.operators import vectors as V
from lodestar.plans import cli, experiment, registry, report
from lodestar.sources import binary, sinks, synthetic
from lodestar.sources import text_files as L


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_tokens_are_pythons(spark):
    texts = ["Été À_b 9x", "naïve—straße", "日本 語", "", None, "a.b-c", "ǅ ﬁ ½"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(T.tokens(F.col("x"))).collect()]
    assert got[:6] == [re.findall(r"\w+", (t or "").lower()) for t in texts[:6]]


def test_text_functions(spark):
    assert one(spark, "string", " It's,  A\ttest! ", T.normalised) == "its a test"
    assert one(spark, "string", "One. Two!? ", T.sentences) == ["One", "Two", ""]
    assert one(spark, "string", "abcdef", lambda c: T.clipped(c, 3)) == "abc..."
    assert one(spark, "string", "abc", lambda c: T.clipped(c, 3)) == "abc"
    assert one(spark, "string", "abcdefghijklmnopq. rst", lambda c: T.cut_at_sentence(c, 20)) == "abcdefghijklmnopq."
    assert one(spark, "string", "ab. efghijk", lambda c: T.cut_at_sentence(c, 10)) == "ab. efghij"
    assert one(spark, "string", "somewhat odd", T.question_type) == "information"
    assert [one(spark, "double", float(n), lambda c: T.build_time_estimate(c, 100.0)) for n in (5000, 60_000, 1_000_000)] == ["~50s", "~10m", "~2h46m"]


def bm25_plain(docs, query, k1=1.2, b=0.75):
    toks = {d: re.findall(r"\w+", (t or "").lower()) for d, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for d, t in toks.items():
        tf = Counter(t)
        s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avg)) for w in re.findall(r"\w+", query.lower()) if tf[w])
        if round(s, 6) > 0:
            out[d] = round(s, 6)
    return out


def test_bm25_properties(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(30)], k=rnd.randint(0, 40)))) for i in range(60)] + [(98, ""), (99, None)]
    queries = [(1, "w3 w9 w3"), (2, "unknown"), (3, ""), (4, "w0 w20"), (5, "w3 w9 w3 w3 w9 w3")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "qid long, text string")
    run = S.bm25(d, q, k=100).collect()
    for qid, t in queries:
        got = {r.doc_id: r.score for r in run if r.qid == qid}
        assert got == pytest.approx(bm25_plain(docs, t), abs=2e-6)
    small = {(r.qid, r.doc_id, r.rank) for r in S.bm25(d, q, k=3).collect()}
    assert small == {(r.qid, r.doc_id, r.rank) for r in run if r.rank <= 3}
    double = {r.doc_id: r.score for r in run if r.qid == 5}
    assert double == pytest.approx({r.doc_id: 2 * r.score for r in run if r.qid == 1}, abs=3e-6)
    assert {r.qid: r.is_empty for r in S.empty_queries(d, q).collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}


def test_ties_go_to_the_smaller_id(spark):
    d = spark.createDataFrame([(i, 1.0 if i < 8 else 2.0) for i in range(10)], "doc_id long, score double").withColumn("qid", F.lit(1))
    assert [r.doc_id for r in S.top_k(d, 4, "qid").orderBy("rank").collect()] == [8, 9, 0, 1]


@pytest.mark.parametrize("kind", ["normal", "uniform", "zipf", "bimodal"])
def test_approximate_top_k(spark, kind):
    s = synthetic.scores(spark, 5000, kind).cache()
    got = [r.id for r in S.approx_top_k(s, 50).collect()]
    exact = [r.id for r in s.orderBy(F.desc("score"), "id").limit(50).collect()]
    assert len(got) == 50 and len(set(got) & set(exact)) >= 45


@pytest.mark.parametrize("most", [1 << 20, 1000])
def test_approximate_top_k_of_very_many(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_ACCURATE", most)
    s = spark.range(250_000).select("id", F.rand(3).alias("score")).cache()
    got = [r.id for r in S.approx_top_k(s, 100).collect()]
    assert got == [r.id for r in s.orderBy(F.desc("score"), "id").limit(100).collect()]


def test_index_counts_empty_documents(spark):
    i = I.build(spark.createDataFrame([(1, "a a b"), (2, ""), (3, None)], "doc_id long, text string"))
    assert i.stats.first() == (3, 1.0)
    assert sorted(tuple(r)[:3] for r in i.postings.collect()) == [(1, "a", 2), (1, "b", 1)]


def test_index_is_kept_by_content(spark, tmp_path):
    d = spark.createDataFrame([(1, "a a b"), (2, "c")], "doc_id long, text string")
    key = I.content_key(d)
    assert key == I.content_key(d.orderBy("text", ascending=False)) != I.content_key(d.withColumn("text", F.upper("text")))
    assert G.load(spark, str(tmp_path), key) is None
    G.save(d, str(tmp_path), key)
    assert sorted(G.load(spark, str(tmp_path), key).postings.collect()) == sorted(I.build(d).postings.collect())


def readers_input(spark, contexts, query="what is a word here"):
    return spark.createDataFrame([(1, query, contexts)], "qid long, query string, contexts array<string>")


def test_readers(spark):
    first = lambda f, *a: f(readers_input(spark, *a)).first().answer
    assert first(C.extractive, []) == C.NO_CONTEXT
    assert first(C.extractive, ["No match at all. Here is a word. And a word here"]) == "Here is a word"
    assert first(C.extractive, ["short", "tiny"], "zzz") == "short..."
    assert first(C.generative, ["x", "y"]) == "According to the information: x | y"
    assert first(C.generative, ["x"], "somewhat why") == "According to the information: x"
    assert first(C.generative_smart, ["x"], "please") == "Regarding your question: x"
    assert first(C.generative_smart, [" "], "please").startswith("The available")
    assert first(C.extractive_weighted, ["A word of it all. Is a word here"]) == "Is a word here"
    assert first(C.first_context, ["z" * 300]) == "z" * 200 + "..."


def test_context_dedupe(spark):
    rows = [(1, 1, 1, "a" * 250), (1, 2, 2, "a" * 300), (1, 3, 3, "short"), (1, 4, 4, "b" * 20), (1, 5, 6, "c" * 50)]
    ctx = spark.createDataFrame(rows, "qid long, doc_id long, rank long, context string")
    assert sorted(r.doc_id for r in C.dedupe_by_prefix(ctx).collect()) == [1, 4]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=70), st.lists(st.sampled_from("abcd"), max_size=70))
def test_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert M._lcs(a, b) == t[-1][-1]


def test_generation_metrics_at_the_edges(spark):
    rows = [(1, "a b c d e", "a b c d e"), (2, "a b c", "a b c"), (3, "", ""), (4, "x", ""), (5, "A, b! c d", "a b c d e f g h")]
    p = spark.createDataFrame(rows, "k long, pred string, ref string")
    assert {r.k: r.bleu for r in M.bleu(p, "k").collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.5}
    assert {r.k: r.f1 for r in M.rouge_l(p, "k").collect()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0, 5: pytest.approx(2 / 3, abs=1e-6)}
    assert {r.k: r.recall for r in M.rouge_n(p, 2, "k").collect()}[5] == pytest.approx(3 / 7, abs=1e-6)


def test_ranking_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid long, doc_id long, rank long")
    rel = spark.createDataFrame([(1, 11, 1), (1, 99, 1), (2, 5, 1), (1, 10, 0)], "qid long, doc_id long, rel int")
    got = {r.qid: r for r in M.ranking_metrics(run, rel, 10).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got[1].ndcg == pytest.approx(1 / math.log2(3) / ideal) and got[1].ap == 0.25 and got[1].recall == 0.5 and got[1].precision == 0.1
    assert got[2].ndcg == 0


@pytest.mark.parametrize("n", [1, 2, 19, 20, 99, 100, 101])
def test_latency_summary_switches_methods(spark, n):
    rnd = random.Random(n)
    v = [round(rnd.expovariate(0.1), 2) for _ in range(n)]
    log = spark.createDataFrame([(i, x, False) for i, x in enumerate(v)] + [(9999, 1e9, True)], "query_id long, latency_ms double, failed boolean")
    r = N.latency_summary(log).first()
    assert r.p95_ms == pytest.approx(statistics.quantiles(v, n=20)[18] if n >= 20 else max(v), abs=1e-5)
    assert r.p99_ms == pytest.approx(statistics.quantiles(v, n=100)[98] if n >= 100 else max(v), abs=1e-5)
    assert (r.n, r.n_failed, r.max_ms) == (n, 1, max(v))


def test_rolling_windows_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(N, "_CHUNK", 7)
    rows = [(i, float(i * i % 101), i % 5 == 0) for i in range(200)]
    log = spark.createDataFrame(rows, "query_id long, latency_ms double, failed boolean").withColumn("ts", F.timestamp_seconds(F.col("query_id") * 600))
    ok = [v for _, v, f in rows if not f]
    want = [round(sum(ok[max(0, i - 29) : i + 1]) / len(ok[max(0, i - 29) : i + 1]), 9) for i in range(len(ok))]
    assert [r.rolling_ms for r in N.rolling_latency(log, 30).orderBy("query_id").collect()] == pytest.approx(want)


def test_quantisation_edges(spark):
    rows = [(0, [0.0] * 4), (1, [0.5] * 4), (2, [1.0, -1.0, 0.5 / 127, 1.5 / 127]), (3, [3.0, -2.0, 0.1, 0.0])]
    d = spark.createDataFrame(rows, "i long, v array<float>")
    for rounding in ("half_even", "truncate"):
        q, s = V.quantise_symmetric(F.col("v"), rounding)
        a, s2, z = V.quantise_asymmetric(F.col("v"), rounding)
        for r in d.select("i", "v", q.alias("q"), s.alias("s"), V.dequantise(a, s2, z).alias("back"), s2.alias("s2")).collect():
            step = r.s / 127 if rounding == "half_even" else r.s
            assert np.abs(np.array(r.q) * step - np.array(r.v)).max() <= step * 1.001
            assert np.abs(np.array(r.back) - np.array(r.v)).max() <= r.s2 * 1.001
            if r.i == 0:
                assert set(r.q) == {0}


def test_quantised_search_agrees_with_exact(spark):
    c = synthetic.clustered_vectors(spark, 400, 16, 10).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")).cache()
    exact = c.withColumn("scale", F.lit(1.0))
    q, s = V.quantise_symmetric(F.col("v"))
    quick = c.select("doc_id", q.alias("v"), (s / 127).alias("scale"))
    ask = lambda x: x.filter("doc_id < 20").withColumnRenamed("doc_id", "qid")
    a, b = V.top_by_dot(exact, ask(exact), 10), V.top_by_dot(quick, ask(quick), 10)
    assert M.rank_agreement(a, b, 10).agg(F.avg("overlap")).first()[0] >= 0.9
    m = np.array([r.v for r in c.orderBy("doc_id").collect()])
    best = (m[:20] @ m.T).argmax(axis=1)
    assert [r.doc_id for r in a.filter("rank = 1").orderBy("qid").collect()] == best.tolist()


def test_grades(spark):
    r = spark.createDataFrame([(v,) for v in (1.1, 1.0, 0.9, 0.75, 0.5, 0.1)], "v double").select(N.grade(F.col("v"), F.lit(1.0))).collect()
    assert [x[0] for x in r] == ["A+", "A", "B", "C", "D", "F"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "qrels").mkdir()
    docs = [json.dumps({"_id": f"d{i}", "title": "T", "text": f"document number {i} about topic{i % 3}"}) for i in range(12)]
    (tmp_path / "corpus.jsonl").write_text("\n".join([*docs, ""]))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": f"q{i}", "text": f"what is topic{i}"}) for i in range(3)))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq0\td0\t1\nq1\td1\t1\n")
    return tmp_path


def test_files(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"id": "", "_id": "a", "content": "x"}\n\n{bad\n{"docid": 7, "text": ""}\n{"text": "y"}\n{"id": "a", "body": "later"}\n{"id": null, "text": null}\n[1]\n')
    got = {(r.doc_id, r.text) for r in L.load_corpus(L.lines(spark, str(f))).collect()}
    assert got == {("a", "later"), ("7", ""), ("doc_5", "y"), ("doc_7", None)}
    assert [r.ord for r in L.validate_jsonl(L.lines(spark, str(f)).filter("line <> ''")).orderBy("ord").collect()] == [3, 8]
    q = tmp_path / "q.tsv"
    q.write_text("q1 d1 1.0\nq1\td2\t0\nq2\td3\nq3\td4\tx\n")
    assert {tuple(r) for r in L.load_qrels(L.lines(spark, str(q))).collect()} == {("q1", "d1", 1), ("q1", "d2", 0)}
    v = tmp_path / "v.f32"
    np.arange(12, dtype="<f4").tofile(v)
    assert [r.embedding for r in binary.register(spark).read.format("lodestar_vectors").option("n", 3).load(str(v)).orderBy("vec_id").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert len(L.checksum(spark, str(v)).first().sha256) == 64


def test_validation(spark, folder):
    ok, found, stats = report.validate(spark, str(folder))
    assert ok and found.isEmpty() and stats.first().n_docs == 12
    (folder / "qrels/test.tsv").write_text("wrong\nq0\td0\t3\nq9\td0\t1\nq0\td0\n")
    ok, found, _ = report.validate(spark, str(folder))
    assert not ok
    assert {(r.ord, r.error) for r in found.collect()} == {(1, "invalid header"), (2, "score is not 0 or 1"), (3, "unknown query"), (4, "expected 3 fields")}


def test_experiments(spark, folder, tmp_path):
    base = {"output_dir": f"{tmp_path}/out", "experiments": [{"name": "x", "dataset": str(folder), "retriever": {"type": "bm25", "params": {"k1": 1.2, "top_k": 5}}, "reader": {"type": "extractive"}}]}
    grid = dict(experiment.ablations(base, {"retriever.type": ["bm25", "tfidf"], "reader.type": ["generative", "nothing"]}))
    assert len(grid) == 4 and all(c["experiments"][0]["dataset"] == str(folder) for c in grid.values())
    done = [experiment.run_all(spark, c) for c in grid.values()]
    assert [d["failed"] for d in done] == [0, 1, 0, 1]
    p = spark.read.json(f"{tmp_path}/out/retriever.type=bm25,reader.type=generative")
    assert {r.qid for r in p.collect()} == {"q0", "q1", "q2"}
    assert all(r.answer.startswith("According") and r.contexts for r in p.collect())
    rel = L.load_qrels(L.lines(spark, f"{folder}/qrels/test.tsv"))
    counts, _ = report.errors(p, rel)
    assert {r.category for r in counts.collect()} <= {"no_gold_standard", "reader_issue", "retriever_miss"}
    refs = spark.createDataFrame([("q0", "According to topic0"), ("q1", "")], "qid string, answer string")
    assert report.evaluate(p, refs).first().n == 1
    with pytest.raises(ValueError, match="Unknown retriever"):
        registry.retrievers.create("none")


def test_hybrid_and_registration(spark):
    d = synthetic.clustered_vectors(spark, 30, 8, 3).select(F.col("vec_id").alias("doc_id"), "embedding", F.concat(F.lit("t"), F.col("label")).alias("text"))
    q = d.filter("doc_id < 2").withColumnRenamed("doc_id", "qid")
    got = registry.retrievers.create("hybrid")(d, q, 5).collect()
    assert len(got) == 10 and all(r.doc_id == r.qid for r in got if r.rank == 1)
    registry.readers.register("Mine", lambda **_: lambda x: x.select("qid", F.lit("!").alias("answer")))
    assert registry.readers.create("Mine")(readers_input(spark, [])).first().answer == "!"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", None), (1, "", "z")], "id long, a string, c string")
    sinks.json_lines(d, f"{tmp_path}/j")
    assert sorted(spark.read.text(f"{tmp_path}/j").collect()) == [('{"id":1,"c":"z"}',), ('{"id":2,"a":"b"}',)]
    assert sinks.markdown(d, "R").splitlines()[2:5] == ["| id | a | c |", "|----|---|---|", "| 1  |   | z |"]
    many = spark.range(2500)
    assert len(sinks.markdown(many, "R").splitlines()) == 2504


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rows = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(4000)]
    (tmp_path / "a.txt").write_text("\r\n".join(rows[:1500]) + "\r\n")
    (tmp_path / "b.txt").write_text("\n".join(rows[1500:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        one = L.lines(spark, str(tmp_path / "b.txt"))
        assert [r.line for r in one.orderBy("ord").collect()] == rows[1500:]
        both = L.lines(spark, str(tmp_path)).orderBy("ord").collect()
        assert [r.line for r in both] == rows and [r.ord for r in both] == list(range(1, 4001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_passages_of_any_length_anywhere(spark):
    docs = [(1, "alpha beta gamma"), (2, "xalpha betax"), (3, ""), (4, None), (5, "beta")]
    passages = [(1, "alpha beta"), (2, "beta"), (3, ""), (4, None), (5, "a b"), (6, "beta")]
    got = C.passages_held(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "qid long, text string")).collect()
    want = {(q, d) for q, p in passages for d, t in docs if p is not None and t is not None and p in t}
    assert {(r.qid, r.doc_id) for r in got} == want and len(got) == len(want)


def test_queries_in_blocks_score_alike(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([(f"d{i}", " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(300)], "doc_id string, text string").repartition(5)
    q = spark.createDataFrame([(f"q{i}", " ".join(rnd.choices(words, k=5))) for i in range(20)], "qid string, text string")
    whole = sorted(S.bm25(d, q, 7).collect())
    monkeypatch.setattr(S, "ASKED", 9)
    monkeypatch.setattr(S, "_CELLS", 30)
    assert sorted(S.bm25(d, q, 7).collect()) == whole


def test_gamma_lengths(spark):
    n = [r[0] for r in synthetic.zipf_corpus(spark, 3000).select(F.size(F.split("text", " "))).collect()]
    assert min(n) >= 5 and max(n) <= 200 and 46 < sum(n) / len(n) < 54
    assert 1 <= min(len(r.text.split()) for r in synthetic.zipf_queries(spark, 50).collect())


def test_command_lines(spark, folder, tmp_path, capsys):
    assert cli.main([]) == 2 and "integration OUT" in capsys.readouterr().out
    e = cli.efficiency(spark, str(folder), queries=2)
    assert e["documents"] == 12 and e["build"]["error"] is None and [q["error"] for q in e["queries"]] == [None, None] and [x["n"] for x in e["scaling"]] == [12]
    assert [r.k for r in cli.baseline(spark, str(folder)).orderBy("k").collect()] == [10, 100]
    base = {"output_dir": f"{tmp_path}/a", "experiments": [{"name": "x", "dataset": str(folder), "retriever": {"type": "bm25", "params": {}}, "reader": {"type": "extractive"}}]}
    assert [r["succeeded"] for r in cli.ablate(spark, base, {"reader.type": ["generative_simple", "none"]})] == [1, 0]
    assert [r.error for r in cli.bench(spark, ["topk"]).collect()] == [None]
    grade, advice = cli.integration(spark, f"{tmp_path}/i")
    assert grade.first().score >= 0.5 and all(r.text for r in advice.collect())
    assert spark.read.option("header", True).csv(f"{tmp_path}/i/checks").count() == 6
    assert "# Grade" in "".join(r.value for r in spark.read.text(f"{tmp_path}/i/report").collect())
