"""One scan numbers, validates and parses what several did."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from lodestar.operators import docstore as D
from lodestar.plans import report
from lodestar.sources import one_pass as P
from lodestar.sources import text_files as L


def made(seed, broken):
    rnd = random.Random(seed)
    out = []
    for i in range(300):
        row = {rnd.choice(["_id", "id", "docid"]): rnd.choice([str(i), str(i // 2), "", i]), rnd.choice(["text", "body", "query"]): rnd.choice(["some text", "", None, f" t{i} "]), "title": "x"}
        out.append(rnd.choice([json.dumps(row)] * 6 + ["", "   "]))
        if broken and rnd.random() < 0.1:
            out.append(rnd.choice(["{bad", "[1]", "3", '"s"', "{}", "null", "\t"]))
    return "\n".join(out) + "\n"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_the_same_rows_as_by_several_scans(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits a file
    try:
        for broken in (False, True):
            at = tmp_path / f"lines{broken}"
            at.mkdir()
            for i in range(3):
                (at / f"part{i}.jsonl").write_text(made(i, broken))
            all_ = L.lines(spark, str(at))
            some = all_.filter(F.trim("line") != "")
            read, keep = [], DataFrameReader.text
            with monkeypatch.context() as m:
                m.setattr(DataFrameReader, "text", lambda self, *a, **k: read.append(1) or keep(self, *a, **k))
                got = P.scan(spark, str(at))
                assert rows(P.corpus(got)) == rows(L.load_corpus(all_))
                assert rows(got.errors) == rows(L.validate_jsonl(some) if broken else L.validate_records(some))
                assert got.n == some.count() and got.malformed == L.validate_jsonl(some).count()
                assert got.invalid == L.validate_records(some).select("ord").distinct().count()
                asked = P.scan(spark, str(at), L.QUERY_IDS, L.QUERY_TEXTS, ())
                assert rows(P.queries(asked)) == rows(L.load_queries(all_))
                assert rows(P.lines(spark, str(at)).select("ord", "line")) == rows(all_)
            assert len(read) == 3  # one for each call above
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_validation_reads_each_file_once(spark, tmp_path, monkeypatch):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("".join(json.dumps({"_id": f"d{i}", "text": f"text {i}"}) + "\n" for i in range(20)))
    (tmp_path / "queries.jsonl").write_text("".join(json.dumps({"_id": f"q{i}", "text": "text"}) + "\n" for i in range(3)))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq0\td1\t1\nq1\td99\t1\n")
    read, keep = [], DataFrameReader.text
    monkeypatch.setattr(DataFrameReader, "text", lambda self, *a, **k: read.append(a[0]) or keep(self, *a, **k))
    ok, found, stats = report.validate(spark, str(tmp_path))
    assert not ok and rows(found) == [("qrels", 3, "unknown document")] and stats.first().n_docs == 20
    assert len(read) == len(set(read)) == 3
    for plan in (found, stats):  # what follows reads what the scan has left
        assert "FileScan text" not in plan._jdf.queryExecution().executedPlan().toString()


def test_ids_are_found_by_bucket_and_row_group(spark, tmp_path):
    at = str(tmp_path / "store")
    docs = spark.range(20_000).select((F.col("id") * 3).alias("doc_id"), F.repeat(F.lit("text "), 20).alias("text")).unionByName(spark.createDataFrame([(None, "none")], "doc_id long, text string"))
    D.save(docs, at, buckets=8)
    assert D.load(spark, at).columns == ["doc_id", "text"] and D.load(spark, at).count() == 20_001
    wanted = [9, 30, 31, 59_997, 60_000]
    assert sorted(r.doc_id for r in D.find(spark, at, wanted, 8).collect()) == [9, 30, 59_997]
    table = spark.createDataFrame([(x,) for x in [*wanted, 9, None]], "doc_id long")
    assert sorted(r.doc_id for r in D.find(spark, at, table, 8).collect()) == [9, 30, 59_997]
    assert D.find(spark, at, [], 8).collect() == []
    many = list(range(0, 3000))
    assert D.find(spark, at, many, 8).count() == 1000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = {}
        for wanted in ([9], [10]):  # 10 is within every range of ids: only a Bloom filter rules it out
            found = D.find(spark, at, wanted, 8)
            assert len(found.collect()) == (wanted == [9])
            leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
            read[wanted[0]] = leaf.metrics().apply("numOutputRows").value()
            assert leaf.metrics().apply("numPartitions").value() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < read[9] < 4000 and read[10] == 0
