"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. A passage leaks an item if their
Smith-Waterman alignment over words (match 2, mismatch and gap -1) scores THRESHOLD or
more, as a share of the item's perfect score: copies that are edited, cut, reordered at the
edges or paraphrased in part.

Seeds are pairs of neighbours in the item that a text has at a distance of one or two words.
An alignment of m item words with M matches, a transitions that skip item words and c seeds
scores a + 2 + 2c at most, and a <= min(m - M, 2M - 2tm) at a threshold t; so it holds
c >= tm - 1 - (1 - t)m / 3 seeds (items of three words, where that is none, are
also seeded by their outer words). Hence the seeds most common among the items may be left out, as
many as are sure to be accompanied: the rarest m - c pairs of each item are kept, and at least
one of them is in every leak. Seeds that hit near one diagonal open a passage, as wide as an alignment
through them can be. A passage that holds fewer of the item's words, or seeds, than a leak must
have is passed over; the others are aligned. So no alignment at THRESHOLD is lost.

The different items are broadcast in blocks of BLOCK_BYTES of text, one block after
another, so what is sent has a bound whatever the size of the benchmark; each block is
held against all documents, and which items share a block changes no column. Documents
are never shuffled. Null and empty texts and items match nothing, nor do items of
fewer than MIN_WORDS words. Repeated rows are judged each, whatever their id; repeated
items give rows each. Of equal scores the first passage is reported. Empty tables give none.
Texts of any length are scanned whole, and other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import in_blocks, shipped, table
from .scan import packed_words, slices, text_bytes, word_spans

THRESHOLD = 0.5
MIN_WORDS = 3
BLOCK_BYTES = 16 << 20
#: Seeds of diagonals farther apart than half the item and this open another passage.
MARGIN = 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words looked up at a time.
_LOOKUPS = 1 << 20

#: True for the ASCII bytes that separate words: all but letters and digits.
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words, as a binary array, and the n + 1 offsets of the texts' words."""
    data, off = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, first = word_spans(data, off, _BREAK)
    return packed_words(data, starts, ends), first


def seeds_needed(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many seeds an alignment at the threshold holds at least, for items of so many words."""
    return np.maximum(1, np.ceil(threshold * size - 1 - (1 - threshold) * size / 3 - 1e-9)).astype(np.int64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score, and the places in text where it starts and ends."""
    n = len(text)
    ramp = np.arange(n + 1) * -GAP
    above = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diag = above[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = above[1:] + GAP
        row, come = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = np.maximum(diag, up)
        come[1:] = np.where(take > 0, np.where(diag >= up, start[:-1], start[1:]), come[1:])
        row[1:] = np.maximum(take, 0)
        # gaps in the item: the best of all places to the left, less their distance
        high = np.maximum.accumulate(row + ramp)
        by_gap = high - ramp
        at = np.maximum.accumulate(np.where(row + ramp == high, np.arange(n + 1), 0))
        come = np.where(by_gap > row, come[at], come)
        above, start = np.maximum(row, by_gap), come
        i = int(above.argmax())
        if above[i] > best[0]:
            best = (int(above[i]), int(start[i]), i)
    return best


class Items:
    """A block of test items and the places of their seeds."""

    def __init__(self, ids: list, texts: list, threshold: float = THRESHOLD):
        own, first = words_of(pa.array(texts, pa.string()))
        self.vocabulary, self.threshold = pc.unique(own), threshold
        words = self.numbers(own)
        self.ids, self.words, self.first = ids, words, first
        size = np.diff(first)
        item = np.repeat(np.arange(len(ids)), size)
        place = np.arange(len(words)) - first[item]
        at = np.flatnonzero((place < size[item] - 1) & (size[item] >= MIN_WORDS))
        outer = first[:-1][size == 3]
        one, two = np.concatenate([at, outer]), np.concatenate([at + 1, outer + 2])
        key, item, place = self.pair(words[one], words[two]), item[one], place[one]
        # the rarest pairs of each item, by how many places of the block have them
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        order = np.lexsort((place, times[which], item))
        many = np.bincount(item, minlength=len(ids))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(many) - many, many)
        kept = rank < (many - seeds_needed(size, threshold) + 1)[item]
        key, self.item, self.place = key[kept], item[kept], place[kept]
        order = np.argsort(key, kind="stable")
        key, self.item, self.place = key[order], self.item[order], self.place[order]
        self.keys, self.cut = np.unique(key, return_index=True)
        self.cut = np.append(self.cut, len(key))

    def pair(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """A number for two words, of no other two."""
        return one * len(self.vocabulary) + two

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the vocabulary, or -1: words are compared byte for byte."""
        return pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The key number of each pair, or -1."""
        if not len(self.keys):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, at, -1)

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a seed's first word, key number), for seeds of one or two words' distance in one text."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = []
        for d in (1, 2):
            at = np.flatnonzero((words[:-d] >= 0) & (words[d:] >= 0) & (text[:-d] == text[d:]))
            key = self.find(self.pair(words[at], words[at + d]))
            found.append((at[key >= 0], key[key >= 0]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def _held(self, words: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words of each item stand, each anywhere, in words[begin:end]: no alignment matches more."""
        pos = np.flatnonzero(words >= 0)
        spot = np.sort(words[pos] * (len(words) + 1) + pos)
        size = np.diff(self.first)[item]
        out = np.zeros(len(item), np.int64)
        part = np.cumsum(size) // _LOOKUPS
        for own in np.split(np.arange(len(item)), np.flatnonzero(np.diff(part)) + 1):
            n = size[own]
            shift = np.cumsum(n) - n
            word = self.words[np.arange(n.sum()) + np.repeat(self.first[item[own]] - shift, n)] * (len(words) + 1)
            next_ = np.searchsorted(spot, word + np.repeat(begin[own], n))
            held = spot[np.minimum(next_, len(spot) - 1)] < word + np.repeat(end[own], n)
            out[own] = np.add.reduceat(held & (next_ < len(spot)), shift, dtype=np.int64)
        return out

    def _seeds(self, item: np.ndarray, text: np.ndarray) -> int:
        """How many pairs of neighbours in item, those that open no passage too, text has at a distance of one or two words."""
        there = [self.pair(text[:-d], text[d:])[(text[:-d] >= 0) & (text[d:] >= 0)] for d in (1, 2)]
        return int(np.count_nonzero(np.isin(self.pair(item[:-1], item[1:]), np.concatenate(there))))

    def _seeded(self, item: np.ndarray, text: np.ndarray) -> bool:
        """Whether text has as many seeds of item as an alignment at the threshold."""
        need = int(seeds_needed(np.array(len(item)), self.threshold))
        return need == 1 or self._seeds(item, text) >= need

    def leaks(self, texts: pa.Array) -> Iterator[tuple]:
        """(text number, item number, score, seeds, first word, last word) of texts that hold an item."""
        words, first = words_of(texts)
        words = self.numbers(words)
        pos, key = self.hits(words, first)
        if not len(pos):
            return
        threshold, n = self.threshold, self.cut[key + 1] - self.cut[key]
        hit = np.repeat(pos, n)
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.cut[key], n)
        doc = np.searchsorted(first, hit, "right") - 1
        item, diagonal = self.item[own], hit - first[doc] - self.place[own]
        size = np.diff(self.first)
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        # a new passage where the text or item changes, or the next diagonal is far
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > size[item[1:]] // 2 + MARGIN)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(doc))
        # the gaps of an alignment that reaches the threshold are fewer than this
        drift = np.ceil(MATCH * size * max(0.0, 1 - threshold) / -GAP).astype(np.int64)[item[lo]]
        begin = np.maximum(0, diagonal[lo] - drift)
        end = np.minimum(np.diff(first)[doc[lo]], diagonal[hi - 1] + size[item[lo]] + drift)
        able = self._held(words, item[lo], first[doc[lo]] + begin, first[doc[lo]] + end) >= threshold * size[item[lo]]
        best: dict[tuple[int, int], tuple] = {}
        for a, b, begin, end in zip(*(x[able].tolist() for x in (lo, hi, begin, end)), strict=True):
            d, i = int(doc[a]), int(item[a])
            own, passage = self.words[self.first[i] : self.first[i + 1]], words[first[d] + begin : first[d] + end]
            if not self._seeded(own, passage):
                continue
            score, s, e = align(own, passage)
            share = score / (MATCH * int(size[i]))
            if share >= threshold and share > best.get((d, i), (0.0,))[0]:
                best[d, i] = (share, self._seeds(own, passage[s:e]), begin + s, begin + e - 1)
        for (d, i), found in sorted(best.items()):
            yield (d, i, *found)


def blocks(benchmark: DataFrame, threshold: float) -> Iterator[Items]:
    """The different items, BLOCK_BYTES of text at a time; their texts are their ids. One larger item makes a block of its own."""
    own = benchmark.select("text").filter(F.length("text") > 0).distinct()
    for rows in in_blocks(own, F.octet_length("text") + 16, BLOCK_BYTES):
        texts = sorted(r.text for r in rows)
        yield Items(texts, texts, threshold)


_FOUND = "item string, score double, n_seeds long, first_word long, last_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, n_seeds, first_word, last_word of every leaked item; clean documents have no row.

    n_seeds: the item's pairs of neighbours that the passage from first_word to last_word has at one or two words' distance.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    out = spark.createDataFrame([], f"doc_id long, {_FOUND}")
    for items in blocks(benchmark, threshold):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(own.leaks(part.column("text")))
                    d, i, *rest = zip(*found, strict=True) if found else [()] * 6
                    kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
                    cols = [part.column("doc_id").take(pa.array(d, pa.int64())), pa.array([own.ids[x] for x in i], pa.string())]
                    cols += [pa.array(x, t) for x, t in zip(rest, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item", "score", "n_seeds", "first_word", "last_word"])

        out = out.unionByName(shipped(docs).mapInArrow(run, f"doc_id long, {_FOUND}"))
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    return out.join(named, "item").select("doc_id", "item_id", "score", "n_seeds", "first_word", "last_word")


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that hold no test item. No shuffle."""
    for items in blocks(benchmark, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                named = pa.RecordBatch.from_arrays(batch.columns, names=["text" if i == at else str(i) for i in range(batch.num_columns)])
                for part in slices(named, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in sent.value.leaks(part.column("text"))]] = False
                    kept = part.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(kept.columns, names=batch.schema.names)

        docs = shipped(docs).mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
