"""Checksums by file, and files of JSON arrays."""

from __future__ import annotations

import hashlib
import json

import pytest

from lodestar.sources import sinks
from lodestar.sources import text_files as L


@pytest.mark.parametrize("whole", [1 << 20, 3, 0])
def test_checksums(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(L, "WHOLE", whole)
    files = {"a": b"", "b": b"abc", "c/d": bytes(range(256)) * 5000, "c/e f": b"x"}
    (tmp_path / "c").mkdir()
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    got = {r.path.split(str(tmp_path))[1].lstrip("/").replace("%20", " "): r.sha256 for r in L.checksum(spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256(data).hexdigest() for n, data in files.items()}
    assert [r.sha256 for r in L.checksum(spark, str(tmp_path / "b")).collect()] == [hashlib.sha256(b"abc").hexdigest()]


def test_json_arrays(spark, tmp_path):
    rows = [(str(i), f"text {i}\n[,]") for i in range(10)]
    sinks.json_arrays(spark.createDataFrame(rows, "qid string, query string").repartition(4), str(tmp_path / "p"))
    files = list((tmp_path / "p").glob("part-*"))
    own = [r for f in files if f.stat().st_size for r in json.loads(f.read_text())]
    assert len(files) > 1 and sorted((r["qid"], r["query"]) for r in own) == sorted(rows)
    assert sorted((r.qid, r.query) for r in L.load_predictions(spark, str(tmp_path / "p")).collect()) == sorted(rows)
