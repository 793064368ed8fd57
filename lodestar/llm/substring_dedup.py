"""Exact substring deduplication over 50-word windows, by super-k-mer partitioning.

A word goes if a window covers it whose word sequence also starts in a document
of smaller id. The minimiser of a window is the least hash of its GRAM-word
grams; consecutive windows with one minimiser form a super-k-mer, which travels
as one packed string (its words, joined by spaces) to the minimiser's bucket,
where the windows of all strings are numbered exactly, sorted and counted.

Only minimisers that more than one document has need to travel. A first scan
gives each document's minimisers; those that occur once are left at home, so
what is packed follows the repeated part of the corpus. Equal packed strings
are aggregated before and in the shuffle. A minimiser with more than HOT
super-k-mers is split: its windows travel one by one, to the bucket of their
own hash, where equal ones meet all the same. No super-k-mer is longer than one gram can be
the minimiser of; where a text repeats itself, the rest makes further ones for the same bucket. So what
a packed string gives is bounded, and strings of more than a share of all rows meet theirs by a broadcast.

Nulls and empty texts have no words and lose none. Documents shorter than a
window keep all. Rows that repeat an id do not count as another document; a
null id counts as larger than any other. The windows are judged on the input. Of equal windows
those of the smallest id stay, in every row that has it. Texts of any length are taken whole; an empty
table gives an empty one; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, shipped, table
from .joins import looked_up
from .scan import mixed, run_numbers, slices, span_hashes, text_bytes, word_numbers, word_spans

WINDOW = 50
GRAM = 8
HOT = 20_000
#: Bytes of text that a task hashes at a time; the tables of 64-bit words beside it take 50 times as much.
_BYTES = 1 << 20
_LAST_ID = (1 << 63) - 1


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours, at the first one's place."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = n - width
    return x if not rest else np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]


def super_kmers(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of all super-k-mers, of window - gram + 1 windows at most.

    hashes: of the words of several documents; first: the n + 1 offsets of the documents' words.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.astype(np.uint64), none, none
    grams = np.zeros(n - gram + 1, np.uint64)
    factor = 1
    for j in range(gram):
        grams += hashes[j : n - gram + 1 + j] * np.uint64(factor)
        factor = factor * 0x2545F4914F6CDD1D % (1 << 64)
    least = _sliding_min(mixed(grams), window - gram + 1)
    size = np.diff(first)
    end = np.repeat(first[1:], size)[: n - window + 1]
    valid = np.arange(n - window + 1) + window <= end
    if not valid.any():
        return none.astype(np.uint64), none, none
    change = np.ones(len(valid), bool)
    change[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(valid & change)
    stop = np.ones(len(valid), bool)
    stop[:-1] = (least[1:] != least[:-1]) | ~valid[1:]
    n_windows = np.flatnonzero(valid & stop) + 1 - starts
    most = window - gram + 1
    pieces = -(-n_windows // most)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, n_windows = np.repeat(starts, pieces) + piece * most, np.repeat(n_windows, pieces) - piece * most
    return least[starts], starts, np.minimum(n_windows, most)


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BYTES):
                data, off = text_bytes(part.column("text"))
                starts, ends, first = word_spans(data, off)
                mins, at, n = super_kmers(span_hashes(data, starts, ends), first, window, gram)
                cut = pa.array(np.searchsorted(at, first), pa.int32())
                doc = np.searchsorted(first, at, "right") - 1
                raw = data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("key"), pa.array(np.diff(first), pa.int64()), pa.array(sha),
                    pa.ListArray.from_arrays(cut, pa.array(mins.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(at - first[doc], pa.int32())),
                    pa.ListArray.from_arrays(cut, pa.array(n, pa.int32())),
                ], names=["doc_id", "key", "n_words", "sha", "mins", "starts", "counts"])

    return run


def _pack(window: int):
    """Documents with the super-k-mers that are to travel -> one row per packed string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BYTES):
                rows: list[tuple] = []
                for order, key, text, found in zip(*[part.column(c).to_pylist() for c in ("order", "key", "text", "found")], strict=True):
                    words = text.encode().split()
                    for k in found:
                        a, n = k["start"], k["count"]
                        if not k["hot"]:
                            packed = b" ".join(words[a : a + n + window - 1])
                            rows.append((k["min"], _digest(packed), packed, order, key, a))
                        else:
                            for i in range(a, a + n):
                                packed = b" ".join(words[i : i + window])
                                pid = _digest(packed)
                                rows.append((int.from_bytes(pid[:8], "little", signed=True), pid, packed, order, key, i))
                        if len(rows) >= 20_000:
                            yield _packed(rows)
                            rows = []
                if rows:
                    yield _packed(rows)

    return run


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "pid", "packed", "order", "key", "start"])


def count_windows(window: int):
    """Over packed strings sorted by bucket: per string, runs of windows and the least order they occur at."""

    def groups(pid: pa.Array, packed: pa.Array, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        data, off = text_bytes(packed)
        starts, ends, first = word_spans(data, off)
        n = np.maximum(np.diff(first) - window + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
        # equal numbers are equal windows, byte for byte
        number = run_numbers(word_numbers(data, starts, ends), window)[at] if len(at) else at
        order = np.lexsort((low[row], number))
        same = number[order][1:] == number[order][:-1]
        head = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
        run = np.cumsum(head) - 1
        least = np.empty(len(order), np.int64)
        least[order] = low[row][order][head][run] if len(order) else 0
        # what some document of the string has seen before it
        old = least < high[row]
        new = old.copy()
        new[1:] &= ~old[:-1] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        end = old.copy()
        end[:-1] &= ~old[1:] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        a, z = np.flatnonzero(new), np.flatnonzero(end) + 1
        return pa.RecordBatch.from_arrays(
            [pid.take(pa.array(row[a])), pa.array(at[a] - first[:-1][row[a]], pa.int32()), pa.array(z - a, pa.int32()), pa.array(least[a])],
            names=["pid", "at", "count", "least"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_held = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            bytes_held += b.nbytes
            key = b.column("bucket").to_numpy()
            last = int(np.argmax(key == key[-1]))
            if bytes_held < 2 * _BYTES or (last == 0 and held[0].column("bucket")[0].as_py() == key[-1]):
                continue
            held[-1], rest = b.slice(0, last), b.slice(last)
            yield from emit(held)
            held, bytes_held = [rest], rest.nbytes
        yield from emit(held)

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([x for x in held if x.num_rows] or held).combine_chunks() if held else None
        if t is not None and t.num_rows:
            c = {k: t[k].combine_chunks() for k in t.column_names}
            yield groups(c["pid"], c["packed"], c["low"].to_numpy(), c["high"].to_numpy())

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with word ranges to go -> the number of words gone and the hash of the rest."""
    for batch in batches:
        order, key = batch.column("order"), batch.column("key")
        gone, sha = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.encode().split()
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, [s["a"] for s in spans], 1)
            np.add.at(step, [s["z"] for s in spans], -1)
            keep = np.flatnonzero(np.cumsum(step[:-1]) == 0)
            gone.append(len(words) - len(keep))
            sha.append(hashlib.sha256(b" ".join([words[i] for i in keep.tolist()])).hexdigest())
        yield pa.RecordBatch.from_arrays([order, key, pa.array(gone, pa.int64()), pa.array(sha)], names=["order", "key", "n_removed", "kept_sha256"])


def _keyed(docs: DataFrame) -> DataFrame:
    """order stands for the id, nulls last; with key, a hash of the text, it names a row and its repeats."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("order"), F.xxhash64("text").alias("key"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, documents with repeats and their text, their word ranges [a, z) to go)."""
    rows = _keyed(docs)
    schema = "doc_id long, key long, n_words long, sha string, mins array<long>, starts array<int>, counts array<int>"
    scanned = materialise(shipped(rows.select("doc_id", "key", "text")).mapInArrow(_scan(window, gram), schema), "scanned")
    scanned = scanned.withColumn("order", F.coalesce("doc_id", F.lit(_LAST_ID)))
    kmers = scanned.select("order", "key", F.inline(F.arrays_zip(F.col("mins").alias("min"), F.col("starts").alias("start"), F.col("counts").alias("count"))))
    kmers = kmers.toDF("order", "key", "min", "start", "count")
    shared = kmers.groupBy("min").agg(F.min("order").alias("lo"), F.max("order").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = materialise(shared.filter("lo < hi").select("min", "n", (F.col("n") > HOT).alias("hot")), "shared-minimisers")
    found = looked_up(kmers, "min", shared.select("min", "hot"), shared.select("min", "n"))  # boilerplate has few minimisers, of a row for each document
    found = found.groupBy("order", "key").agg(F.collect_set(F.struct("min", "start", "count", "hot")).alias("found"))
    texts = materialise(rows.select("order", "key", "text").join(found, ["order", "key"]), "with-repeats")
    kinds = "bucket long, pid binary, packed binary, order long, key long, start int"
    packed = materialise(texts.mapInArrow(_pack(window), kinds), "packed")
    strings = packed.groupBy("bucket", "pid", "packed").agg(F.min("order").alias("low"), F.max("order").alias("high"))
    strings = strings.repartition("bucket").sortWithinPartitions("bucket")
    runs = materialise(strings.mapInArrow(count_windows(window), "pid binary, at int, count int, least long"), "window-runs")
    spans = looked_up(packed.select("pid", "order", "key", "start"), "pid", runs).filter("least < order")
    spans = spans.select("order", "key", (F.col("start") + F.col("at")).alias("a"), (F.col("start") + F.col("at") + F.col("count") + window - 1).alias("z"))
    return scanned, texts, spans


def dedupe(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    scanned, texts, spans = repeated_spans(docs, window, gram)
    per = spans.groupBy("order", "key").agg(F.collect_set(F.struct("a", "z")).alias("spans"))
    cut = texts.select("order", "key", "text").join(per, ["order", "key"])
    cut = cut.mapInArrow(_remove, "order long, key long, n_removed long, kept_sha256 string")
    cut = cut.groupBy("order", "key").agg(F.max("n_removed").alias("n_removed"), F.max("kept_sha256").alias("kept_sha256"))
    d = scanned.select("doc_id", "order", "key", "n_words", "sha").join(cut, ["order", "key"], "left")
    return d.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedupe(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)
), m AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS lo FROM s) WHERE lo < doc_id
), x AS (
  SELECT doc_id, p, w FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d)
), c AS (
  SELECT x.doc_id, x.p, x.w, m.i FROM x ASOF LEFT JOIN m ON x.doc_id = m.doc_id AND x.p >= m.i
), k AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY p) FILTER (WHERE i IS NULL OR p >= i + {WINDOW}) AS kept,
         count(*) FILTER (WHERE p < i + {WINDOW}) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
