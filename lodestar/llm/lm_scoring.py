"""Language-model scoring: prediction by partial matching over bytes, and a word base line.

The training documents are those whose crc32(id as text) mod FOLDS is not HELD_OUT.
The trie holds all byte contexts of up to ORDER bytes that training texts show,
lower-cased, each text closed by an end symbol. Escapes are estimated by method C
(the number of distinct symbols that followed); on escape, the symbols seen in
the longer context are excluded from the shorter one. Since those are a subset of
what the shorter context has seen, the excluded mass depends on the longer
context only, so each trie node carries one escape weight and scoring is a table
look-up. A document's score is its pretrained log10 probability.

All contexts count. The trie is sparse: contexts and the symbols after them are sets of bits
with ranks, and only what training showed has a number. All contexts shorter than ORDER go to
the executors (fewer than 2 ** 24 grams by arithmetic), and of the longest ones the most frequent, up to
SENT_CONTEXTS of them and SENT_GRAMS of their grams. The rest stays in a table, which the
grams to be scored in them meet in a join, with the same result. Word counts are exact and have no bound:
words more frequent than one in HEAVY tokens, fewer than HEAVY by arithmetic, go to the
executors, the rest meets its counts in a join.

A null text is empty; an empty one has one token, its end. Repeated rows are
counted and scored each; of equal contexts in number the lesser is sent. A null id counts as an empty
text: training. An empty table gives an empty one. Texts of any length are scored whole, a stretch of
bytes at a time. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise, shipped, table
from .scan import slices, text_bytes

FOLDS = 7
HELD_OUT = 2
ORDER = 3
SENT_CONTEXTS = 1 << 17
SENT_GRAMS = 1 << 21
HEAVY = 200_000
#: A byte that UTF-8 never uses; stands before and after each text.
_END = 0xFF
_FLUSH = 200_000
#: Bytes of text that a task codes at a time; one longer text makes a stretch of its own.
_BYTES = 1 << 20
#: Codes looked up at a time.
_LOOKUPS = 1 << 18


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def framed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each coded byte with the ORDER bytes before it, and the n + 1 offsets of the texts' codes.

    Each text is coded with its end symbol; contexts begin with end symbols.
    """
    n = len(off) - 1
    b = np.full(len(data) + (ORDER + 1) * n, _END, np.uint8)
    coded = np.ones(len(b), bool)
    for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        at = a + (ORDER + 1) * i
        coded[at : at + ORDER] = False
        b[at + ORDER : at + ORDER + z - a] = _LOWER[data[a:z]]
    codes = np.zeros(len(b), np.uint32)
    for j in range(ORDER + 1):
        codes[ORDER:] |= b[ORDER - j : len(b) - j].astype(np.uint32) << np.uint32(8 * j)
    return codes[coded], off + np.arange(n + 1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts -> partial counts of words and of byte grams."""

    def out(words: list, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        w, g = len(words), len(codes)
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array([x for x, _ in words], pa.binary()), pa.nulls(g, pa.binary())]),
            pa.concat_arrays([pa.nulls(w, pa.int64()), pa.array(codes.astype(np.int64))]),
            pa.concat_arrays([pa.array([x for _, x in words], pa.int64()), pa.array(counts)]),
        ], names=["word", "gram", "n"])

    none = np.zeros(0, np.int64)
    words: Counter[bytes] = Counter()
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for part in slices(batch, "text", _BYTES):
            data, off = text_bytes(part.column("text"))
            raw = data.tobytes().lower()
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                words.update(raw[a:b].split())
            grams.append(np.unique(framed(data, off)[0], return_counts=True))
            if sum(len(c) for c, _ in grams) > 1 << 21:
                grams = [_merged(grams)]
            if len(words) > _FLUSH:
                items = list(words.items())
                for i in range(0, len(items), 50_000):
                    yield out(items[i : i + 50_000], none, none)
                words.clear()
    items = list(words.items())
    for i in range(0, len(items), 50_000):
        yield out(items[i : i + 50_000], none, none)
    if grams:
        codes, counts = _merged(grams)
        for i in range(0, len(codes), 100_000):
            yield out([], codes[i : i + 100_000], counts[i : i + 100_000])


class Bits:
    """A set of whole numbers below 2 ** width: bits, and how many there are before each 64 of them."""

    def __init__(self, members: np.ndarray, width: int):
        self.bits = np.zeros(max(1, 1 << max(width - 6, 0)), np.uint64)
        np.bitwise_or.at(self.bits, members >> 6, np.uint64(1) << (members & 63).astype(np.uint64))
        n = np.bitwise_count(self.bits).astype(np.int64)
        self.before = (np.cumsum(n) - n).astype(np.int32)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each x among the members, and whether it is one."""
        word, bit = self.bits[x >> 6], np.uint64(1) << (x & 63).astype(np.uint64)
        return self.before[x >> 6] + np.bitwise_count(word & (bit - np.uint64(1))), word & bit != 0


class Level:
    """The contexts of one length: log10 probabilities of the symbols that training showed after
    them, and what an escape to the next shorter contexts adds to the score there."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, below: Level | None):
        """codes, sorted: context bytes, then the symbol; counts: how often."""
        self.order, self.below = order, below
        ctx, which = np.unique(codes >> 8, return_inverse=True)
        self.contexts = Bits(ctx, 8 * order)
        self.symbols = Bits(which << 8 | codes & 255, (max(1, len(ctx)) - 1).bit_length() + 8)
        n, q = np.bincount(which, counts, len(ctx)), np.bincount(which, minlength=len(ctx))
        self.seen = np.log10(counts / (n + q)[which]).astype(np.float32)
        if below is None:  # order 0 escapes to the symbols that training never showed, evenly
            left = np.maximum(256.0 - q, 1)
        else:  # the mass of symbols seen here is excluded from the shorter context
            left = np.maximum(1 - np.bincount(which, 10.0 ** below.score(codes & below.mask), len(ctx)), 1e-7)
        self.escape = (np.log10(q / (n + q)) - np.log10(left)).astype(np.float32)

    @property
    def mask(self) -> int:
        return (1 << (8 * (self.order + 1))) - 1

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code after the others."""
        if not len(self.seen):
            return np.full(len(codes), -math.log10(256)) if self.below is None else self.below.score(codes & self.below.mask)
        ctx, known = self.contexts.find(codes >> 8)
        ctx = np.where(known, ctx, 0)
        at, seen = self.symbols.find(ctx << 8 | codes & 255)
        seen &= known
        out = np.where(seen, self.seen[np.where(seen, at, 0)], np.where(known, self.escape[ctx], 0.0)).astype(np.float64)
        rest = np.flatnonzero(~seen)
        if self.below is not None and len(rest):
            out[rest] += self.below.score(codes[rest] & self.below.mask)
        return out


class Trie:
    """Byte contexts of length 0 to ORDER; all of those shorter than ORDER, and some of the longest."""

    def __init__(self, short: np.ndarray, short_counts: np.ndarray, long: np.ndarray, long_counts: np.ndarray):
        """Codes of ORDER - 1 context bytes and a symbol, then of ORDER, and how often they were seen."""
        level = None
        for k in range(ORDER):
            codes, where = np.unique(short & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
            level = Level(codes, np.bincount(where, short_counts, len(codes)), k, level)
        order = np.argsort(long)
        self.top = Level(long[order], long_counts[order], ORDER, level)

    def score(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.top.score(codes[i : i + _LOOKUPS].astype(np.int64)) for i in range(0, len(codes), _LOOKUPS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def lower(self, codes: np.ndarray) -> np.ndarray:
        """The scores that the next shorter contexts give."""
        return self.top.below.score(codes.astype(np.int64) & self.top.below.mask)


def _member(far: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Whether the contexts are in far, a set of bits."""
    return (far[ctx >> 6] >> (ctx & 63).astype(np.int64)) & 1 == 1


def _far_contexts(grams: DataFrame, model) -> DataFrame:
    """_ctx, its counts of grams by code, their sum and number, and the score of an escape."""

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = model.value[0].lower(batch.column("gram").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low)], names=["gram", "n", "low"])

    d = grams.select("gram", "n").mapInArrow(lower, "gram long, n long, low double").groupBy(F.shiftright("gram", 8).alias("_ctx"))
    d = d.agg(
        F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("by_code"),
        F.sum("n").alias("sum"), F.count(F.lit(1)).alias("kinds"), F.sum(F.pow(F.lit(10.0), F.col("low"))).alias("gone"),
    )
    escape = F.log10(F.col("kinds") / (F.col("sum") + F.col("kinds"))) - F.log10(F.greatest(1 - F.col("gone"), F.lit(1e-7)))
    return d.select("_ctx", "by_code", "sum", "kinds", escape.alias("escape"))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, heavy, far = model.value
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", _BYTES):
                data, off = text_bytes(part.column("text"))
                codes, cut = framed(data, off)
                each = trie.score(codes)
                # grams in contexts of the table: once for each text, with what the shorter context gives
                at = np.flatnonzero(_member(far, codes >> 8)) if len(far) else np.zeros(0, np.int64)
                key, one, far_times = np.unique((np.searchsorted(cut, at, "right") - 1 << 32) | codes[at].astype(np.int64), return_index=True, return_counts=True)
                low = each[at[one]]
                each[at] = 0.0
                far_offs = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) << 32), pa.int32())
                far_lists = [pa.ListArray.from_arrays(far_offs, pa.array(x)) for x in (key & 0xFFFFFFFF, far_times.astype(np.int64), low)]
                score = np.add.reduceat(each, cut[:-1])
                raw = data.tobytes().lower()
                tokens, known, base, rare, times, lens = [], [], [], [], [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    words = raw[a:b].split()
                    logs = [heavy.get(w, 0.0) for w in words]
                    other = Counter([w for w, x in zip(words, logs, strict=True) if not x])
                    tokens.append(len(words) + 1)
                    known.append(len(words) - other.total())
                    base.append(math.fsum(logs))
                    rare += other.keys()
                    times += other.values()
                    lens.append(len(other))
                n = part.num_rows
                offs = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array((task << 40) + row + np.arange(n)), part.column("doc_id"), part.column("held_out"), pa.array(tokens, pa.int64()),
                    pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score),
                    pa.ListArray.from_arrays(offs, pa.array(rare, pa.binary())), pa.ListArray.from_arrays(offs, pa.array(times, pa.int64())),
                    *far_lists,
                ], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times", "far", "far_times", "far_low"])
                row += n

    return run


def gather(docs: DataFrame) -> DataFrame:
    """Exact training counts: (word, null, n) and (null, gram, n)."""
    part = shipped(docs.filter(~held_out()).select("text")).mapInArrow(_gather, "word binary, gram long, n long")
    return materialise(part.groupBy("word", "gram").agg(F.sum("n").alias("n")), "lm-counts")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = gather(docs)
    words = counts.filter("word IS NOT NULL").select(F.col("word").alias("_word"), F.col("n").alias("c"))
    n_docs = docs.filter(~held_out()).count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)
    heavy = {bytes(r[0]): math.log10(r[1] + 1) for r in words.filter(F.col("c") * HEAVY > total).toLocalIterator()}
    by_ctx = Window.partitionBy("_ctx")
    grams = counts.filter("gram IS NOT NULL").select("gram", "n", F.shiftright("gram", 8).alias("_ctx"))
    grams = materialise(grams.withColumns({"sum": F.sum("n").over(by_ctx), "kinds": F.count("n").over(by_ctx)}), "lm-grams")
    # the most frequent contexts, as many as both bounds allow
    top = grams.groupBy("_ctx").agg(F.first("sum").alias("sum"), F.first("kinds").alias("kinds")).orderBy(F.desc("sum"), "_ctx").limit(SENT_CONTEXTS).toArrow()
    n_sent = int(np.searchsorted(np.cumsum(top["kinds"].to_numpy()), SENT_GRAMS, "right"))
    last = top.slice(n_sent - 1, 1).to_pylist() if n_sent else []
    sent = (F.col("sum") > last[0]["sum"]) | ((F.col("sum") == last[0]["sum"]) & (F.col("_ctx") <= last[0]["_ctx"])) if last else F.lit(False)
    beyond = grams.filter(~sent)
    short = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * ORDER)) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    long = grams.filter(sent).select("gram", "n").toArrow()
    trie = Trie(*(t[c].to_numpy() for t in (short, long) for c in ("gram", "n")))
    bits = beyond.groupBy(F.shiftright("_ctx", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(_ctx & 63 as int)))").alias("bits"))
    bits = bits.toArrow()  # 4 MB for all contexts there can be
    far = np.zeros((1 << (8 * ORDER - 6)) if bits.num_rows else 0, np.int64)
    far[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    model = spark.sparkContext.broadcast((trie, heavy, far))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, times array<long>, far array<long>, far_times array<long>, far_low array<double>"
    rows = materialise(docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_score(model), schema), "lm-rows")
    rare = rows.select("row", F.inline(F.arrays_zip("rare", "times"))).toDF("row", "word", "times")
    rare = rare.join(words.filter(F.col("c") * HEAVY <= total), F.col("word") == F.col("_word"))
    rare = rare.groupBy(F.col("row").alias("_row")).agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    d = rows.drop("rare", "times", "far", "far_times", "far_low").join(rare, F.col("row") == F.col("_row"), "left").drop("_row")
    score = F.col("score")
    if len(far):
        more = rows.select("row", F.inline(F.arrays_zip("far", "far_times", "far_low"))).toDF("row", "code", "far_times", "low")
        more = more.join(_far_contexts(beyond, model), F.shiftright("code", 8) == F.col("_ctx"))
        own = F.log10(F.try_element_at("by_code", F.col("code")) / (F.col("sum") + F.col("kinds")))
        more = more.groupBy(F.col("row").alias("_row")).agg(F.sum(F.col("far_times") * F.coalesce(own, F.col("escape") + F.col("low"))).alias("far_score"))
        d = d.join(more, F.col("row") == F.col("_row"), "left")
        score = score + F.coalesce("far_score", F.lit(0.0))
    known = F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(n_docs > 0))
    logs = F.col("base") + F.coalesce("logs", F.lit(0.0)) + F.lit(math.log10(n_docs + 1)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return d.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), logs.alias("base_score"), score.alias("score"))


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
