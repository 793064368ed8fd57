from __future__ import annotations

import hashlib
import io
import random

import pytest

from lodestar.llm import warc
from lodestar.runtime import scratch_path

SCHEMA = "page_id long, url string, html string, revisits long, payload_digest string"


def brute(rows):
    pay = [((h or "").encode()) for _, _, h, *_ in rows]
    out = []
    for (p, *_), b in zip(rows, pay, strict=True):
        twins = [q[0] for q, c in zip(rows, pay, strict=True) if c == b]
        known = [t for t in twins if t is not None]
        first = max(known) if known else None
        again = len(b) >= 1000 and p != first
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [warc.BROADCAST_ROWS, 1])
def test_round_trip(spark, monkeypatch, sent):
    """All repeats broadcast, and only those of a fifth of the copies."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(warc, "SHARE", 5)
    rnd = random.Random(6)
    big = ["<p>" + "".join(rnd.choices("abcdé \r\n", k=n)) for n in (996, 997, 1500, 9000)]
    rows = [(i, f"http://x/{i}", rnd.choice([*big, "", None, "small", "\r\n\r\n"]), 1, "clash") for i in range(150)]
    rows += [(999, None, "ü" * 499, 1, ""), (998, "a b\r\nX: 1 ", "ü" * 500, 1, ""), (997, "", "ü" * 500, 1, ""), (None, "u", big[3], 1, ""), (500, "u", "x" * 2_000_000, 1, ""), (500, "u", "x" * 2_000_000, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = warc.write_archives(df, scratch_path(spark, "test-warc"))
    got = warc.read_archives(manifest).collect()
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == brute(rows)
    text = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h, *_ in rows}
    assert all(bytes(r.payload) == text[r.payload_digest] if r.record_type == "response" else r.payload is None for r in got)


def test_empty(spark):
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA), scratch_path(spark, "test-warc"))
    assert warc.read_archives(manifest).collect() == []


@pytest.fixture
def archive():
    pages = [f"<html><body>page {i} of the same site, with the same words" * 5 for i in range(300)]
    out = io.BytesIO()
    w = warc.Writer(out, warc.train([p.encode() for p in pages], 4096))
    for i, p in enumerate(pages):
        b = p.encode()
        w.add(warc.record(i, f"http://x/{i}", b, hashlib.sha1(b).hexdigest(), len(b), None))
    return out.getvalue(), pages


def read(data):
    return [warc.parse(f) for f in warc.frames(io.BytesIO(data))]


def test_the_dictionary_leads_and_is_needed(archive):
    data, pages = archive
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert [r["payload"].decode() for r in read(data)] == pages
    with pytest.raises(warc.ArchiveError):
        read(data[8 + int.from_bytes(data[4:8], "little") :])


def test_cut_and_damaged_archives(archive):
    data, _ = archive
    for n in (20, len(data) // 2, len(data) - 1):
        with pytest.raises(warc.ArchiveError):
            read(data[:n])
    bad = bytearray(data)
    bad[-10] ^= 255
    with pytest.raises(warc.ArchiveError):
        read(bytes(bad))


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"WARC/1.1", b"WARD/1.1"), (b"WARC-Date: ", b"WARC-Dote: "), (b"Content-Length: ", b"Content-Length: 1"), (b"page", b"pagf"), (b"sha1:", b"sha1:A")],
)
def test_headers_and_lengths_are_checked(old, new):
    b = b"<p>page"
    r = warc.record(1, "http://x", b, hashlib.sha1(b).hexdigest(), len(b), None)
    assert warc.parse(r)["payload"] == b
    with pytest.raises(ValueError):
        warc.parse(r.replace(old, new))


def test_folded_headers():
    b = b"<p>page"
    r = warc.record(1, "http://x", b, hashlib.sha1(b).hexdigest(), len(b), None)
    folded = r.replace(b"WARC-Date: ", b"X-Note: one\r\n  two\r\n\tthree\r\nWARC-Date:\r\n ", 1)
    assert warc.parse(folded) == warc.parse(r)
    with pytest.raises(ValueError):
        warc.parse(r.replace(b"WARC-Date: ", b" folded before any header\r\nWARC-Date: ", 1).replace(b"WARC/1.1\r\n", b"WARC/1.1\r\nbad line\r\n", 1))
