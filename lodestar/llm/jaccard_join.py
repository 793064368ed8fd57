"""Jaccard self-join of documents' word shingles, by token-combination prefixes.

A document's set: the distinct runs of SHINGLE words of its lower-cased text (A to Z); with fewer words,
their whole sequence. Two documents link when 100 * intersection >= PERCENT * union of their sets. Copies of a
set are one class; of the links between classes a spanning forest is found, never all pairs of a group.

Order and classes. All shingles ("tokens") have one global order: rare ones first, frequent ones last, then by hash.
A set of n tokens can lack d = n - ceil(t * n) of those of a partner, so its first d + 1 hold one that the
partner has, within the partner's prefix. Rare tokens are indexed singly. Tokens of RARE documents or more are
indexed by pairs, those of COMMON or more by triples: such tokens are dealt to groups by hash, a group of m tokens gives
all its k-combinations, and errors can spoil them all only if they leave k - 1 tokens or fewer of each group. So a prefix is
extended until single tokens, plus m - k + 1 of each group, make d + 1. Groups are as many as a size class
asks for; a set takes part in each class that a partner may be of.

Counting. Every set gives its SLACK * (d + 1) least tokens by hash, and these are counted over all documents. Sets with d + 1
tokens of their own there ("light") have their prefix in it: it is met by others only. The whole sets of the rest are
counted again, as is what they share; what two sets are known to have is no longer their own. The order uses these counts,
which are the same for all documents, so that no pair is lost, whatever they are.

Verifying. In each round every set of an unsettled bucket (one with two components or more) is compared with one pivot
at most; after ROUNDS rounds, all pairs of a bucket that still are of different components are tested by their
sizes and the bound that 64 counters of tokens give, each at the least signature that both have, and the rest exactly. Tokens are 64-bit hashes:
within a pair of documents of 20,000 words, two unlike shingles share one with a chance below 1e-10.

Nulls, empty texts and those of white space have an empty set, are linked with nothing and have their own id as component.
Repeated rows are one class; ids may repeat, each row is a document of its own. Of a component the smallest id
counts, null ones last. Texts of any length go whole. An empty table gives an empty one; other columns play no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..operators.index import sized
from ..runtime import materialise, shipped, table
from .components import components
from .joins import looked_up
from .scan import mixed, packed_words, slices, text_bytes, word_spans

SHINGLE = 4
PERCENT = 85
#: Documents from which a token is indexed by pairs, and by triples.
RARE, COMMON = 32, 1024
#: Tokens that are counted of each set, as a multiple of the plain prefix.
SLACK = 1.5
#: Errors a set may have for each group of frequent tokens.
SPREAD = 3
#: Rounds with pivots, and members of a bucket, or of a pivot, beyond which they are dealt to several tasks.
ROUNDS, HOT = 2, 20_000
#: Tokens that are sent to where the sets are, at most; beyond that they meet in a shuffle.
_SENT = 1 << 19
_SLOTS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _overlap(n: int, percent: int) -> int:
    """Tokens that a set of n has in common with a partner, at least."""
    return -(-percent * n // 100)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The n + 1 offsets of the rows' sets, and their tokens, ascending within a row."""
    data, off = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = word_spans(data, off)
    many = np.diff(first)
    coded = packed_words(data, starts, ends).dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    own = own[coded.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.uint64)
    row, at = np.repeat(np.arange(len(many)), many), np.arange(len(own))
    left = np.repeat(first[1:], many) - at
    h = np.zeros(len(own), np.uint64)
    for k in range(min(width, int(many.max(initial=0)))):
        more = left > k
        h[more] = mixed(h[more] * _ODD + own[at[more] + k])
    whole = (left >= width) | ((at == first[:-1][row]) & (many[row] < width))
    h, row = h[whole].view(np.int64), row[whole]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return np.searchsorted(row, np.arange(len(many) + 1)), h


def _lists(off: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))


def _scan(width: int, percent: int):
    """Rows' sets: their size, 128 bits that tell the set, and its least tokens by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                off, h = shingle_sets(part.column("text"), width)
                n = np.diff(off)
                most = np.minimum(n, np.ceil(SLACK * (n + percent * n // -100 + 1)).astype(np.int64))
                tells = b"".join([xxhash.xxh3_128_digest(h[a:z].tobytes()) for a, z in zip(off[:-1], off[1:], strict=True)])
                tells = np.frombuffer(tells, np.int64).reshape(-1, 2)
                kept = np.arange(len(h)) - np.repeat(off[:-1], n) < np.repeat(most, n)
                least = _lists(np.concatenate([[0], np.cumsum(most)]), h[kept])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("doc_id", "_h", "_g")], pa.array(n), pa.array(tells[:, 0].copy()), pa.array(tells[:, 1].copy()), least],
                    names=["doc_id", "_h", "_g", "n", "k1", "k2", "least"],
                )

    return run


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                off, h = shingle_sets(part.column("text"), width)
                slot = np.repeat(np.arange(part.num_rows), np.diff(off)) * _SLOTS + (h.view(np.uint64) >> np.uint64(58)).astype(np.int64)
                sketch = np.minimum(np.bincount(slot, minlength=part.num_rows * _SLOTS), 65535).astype(np.uint16)
                sketch = pa.array([x.tobytes() for x in sketch.reshape(-1, _SLOTS)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("v"), pa.array(np.diff(off)), _lists(off, h), sketch], names=["v", "n", "toks", "sketch"])

    return run


def _groups(size_class: int, percent: int) -> int:
    """Groups that frequent tokens are dealt to in a size class, so few that every set's groups suffice; 0: no combinations."""
    low, high = 4**size_class, 4 ** (size_class + 1) - 1
    low = max(1, _overlap(low, percent))
    return min((high - _overlap(high, percent)) // SPREAD, (_overlap(low, percent) - 1) // 3)


def _size_classes(n: int, percent: int) -> range:
    """The classes, by powers of four, of all sizes that a partner may have."""
    return range((max(1, _overlap(n, percent)).bit_length() - 1) // 2, ((n * 100 // percent).bit_length() - 1) // 2 + 1)


def signatures(n: int, levels: list[int], tokens: list[int], percent: int) -> dict[int, bool]:
    """Of a set of n tokens, given in the global order with their levels (2: pairs, 3: triples, below: single), the
    signatures of its extended prefix, and whether they are tokens of level 0."""
    need, out = n - _overlap(n, percent) + 1, {}
    for c in _size_classes(n, percent):
        parts, score, groups = _groups(c, percent), 0, {}
        for level, t in zip(levels, tokens, strict=True):
            if score >= need:
                break
            if level < 2 or not parts:
                out[t] = level == 0
                score += 1
            else:
                own = groups.setdefault((level, t % parts), [])
                own.append(t)
                score += len(own) >= level
        for (level, _), own in groups.items():
            for x in combinations(sorted(own), level):
                out[xxhash.xxh64_intdigest(np.array([c, *x], np.int64).tobytes()) - (1 << 63)] = False
    return out


def _signed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ordered = b.column("ordered")
            off, levels, tokens = ordered.offsets.to_pylist(), ordered.values.field("level"), ordered.values.field("token")
            for i, (v, n) in enumerate(zip(b.column("v").to_pylist(), b.column("n").to_pylist(), strict=True)):
                a, many = off[i], off[i + 1] - off[i]
                found = signatures(n, levels.slice(a, many).to_pylist(), tokens.slice(a, many).to_pylist(), percent)
                m = len(found)
                lone = pc.sum(pc.equal(levels.slice(a, many), 0)).as_py()
                cols = [pa.array(found, pa.int64()), *[pa.array(np.full(m, x)) for x in (v, n, lone)], pa.array(found.values(), pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["sig", "v", "n", "own", "lone"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """v, n, toks, sketch of the wanted (v, _h, _g): each from one row of docs."""
    named = sized(wanted.select("v", F.col("_h").alias("_wh"), F.col("_g").alias("_wg")), _SENT)
    chosen = docs.select("_h", "_g", "text").join(named, (F.col("_h") == F.col("_wh")) & (F.col("_g") == F.col("_wg")))
    chosen = chosen.groupBy("v").agg(F.first("text").alias("text"))
    return materialise(shipped(chosen).mapInArrow(_whole(width), "v long, n long, toks array<long>, sketch binary"), "whole-sets")


def _alike(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _crossed(percent: int):
    """Over rows sorted by (sig, salt), those at home first: pairs of different components that sizes and sketches allow,
    at the least signature that both have."""

    def marks(off: np.ndarray, sigs: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Bits of which of `both` each row has, in words of 64."""
        at = np.searchsorted(both, sigs)
        known = both[np.minimum(at, len(both) - 1)] == sigs
        row, at = np.repeat(np.arange(len(off) - 1), np.diff(off))[known], at[known]
        bits = np.zeros((len(off) - 1, -(-len(both) // 64)), np.uint64)
        np.bitwise_or.at(bits, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        return bits

    def allowed(x, y) -> np.ndarray:
        (v, n, comp, s, earlier), (w, m, other, t, earlier2) = x, y
        near = (comp[:, None] != other[None]) & (100 * np.minimum(n[:, None], m[None]) >= percent * np.maximum(n[:, None], m[None]))
        both = np.intersect1d(earlier[1], earlier2[1])
        if len(both) and near.any():
            a, b = marks(*earlier, both), marks(*earlier2, both)
            for word in range(a.shape[1]):  # what shares an earlier signature is compared there
                near &= (a[:, word, None] & b[None, :, word]) == 0
        i, j = np.nonzero(near)
        out = []
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            apart = np.abs(s[a].astype(np.int32) - t[b]).sum(axis=1)
            # of n + m tokens, apart at least are of one set alone
            ok = 100 * (n[a] + m[b] - apart) >= percent * (n[a] + m[b] + apart)
            out.append(np.stack([v[a[ok]], w[b[ok]]], 1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def distinct(pairs: list[np.ndarray]) -> pa.RecordBatch:
        pair = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            out = []
            if not b.num_rows:
                continue
            sig, salt, home = (b.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "salt", "home"))
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(-1, _SLOTS)
            cols, sigs = (*[b.column(c).to_numpy() for c in ("v", "n", "comp")], sketch), b.column("earlier")
            off, sigs = sigs.offsets.to_numpy().astype(np.int64), sigs.values.to_numpy()
            cut = np.flatnonzero((np.diff(sig) != 0) | (np.diff(salt) != 0) | (np.diff(home.astype(np.int8)) != 0)) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if key != (sig[a], salt[a]):
                    key, held = (sig[a], salt[a]), []
                for lo in range(a, z, 1024):
                    hi, own = min(z, lo + 1024), bool(home[a])
                    part = (*[x[lo:hi] for x in cols], (off[lo : hi + 1] - off[lo], sigs[off[lo] : off[hi]]))
                    for other in [*held, *([part] if own else [])]:
                        out.append(allowed(other, part))
                        if sum(map(len, out)) > 1 << 18:
                            yield distinct(out)
                            out = []
                    if own:
                        held.append(part)
            if out:
                yield distinct(out)

    return run


def _verified(percent: int):
    """Over rows sorted by (a, salt, b), the first with a's own tokens: the b that link to a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.int64)
        for batch in batches:
            us, vs = [], []
            toks = batch.column("toks")
            off, flat = toks.offsets.to_numpy(), toks.values.to_numpy()
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                these = flat[off[i] : off[i + 1]]
                if b is None:
                    own = these
                    continue
                at = np.searchsorted(own, these)
                both = int((own[np.minimum(at, len(own) - 1)] == these).sum())
                if 100 * both >= percent * (len(own) + len(these) - both):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link, as (u, v). a's tokens go once to each task that has some of its partners."""
    pairs = materialise(pairs, "candidates")
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("salts"))
    many = F.broadcast(materialise(shares.filter("salts > 1"), "hot-pivots").withColumnRenamed("a", "_a"))
    salted = pairs.join(many, F.col("a") == F.col("_a"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    partners = salted.join(sets.select("v", "toks"), F.col("b") == F.col("v")).select("a", "salt", "b", "toks")
    pivots = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pivots = pivots.join(sets.select("v", "toks"), F.col("a") == F.col("v")).select("a", "salt", F.lit(None).cast("long").alias("b"), "toks")
    rows = pivots.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialise(shipped(rows).mapInArrow(_verified(percent), "u long, v long"), "set-links")


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (v, comp), after the components that links join are one."""
    a, b = (comp.select(F.col("v").alias(f"_{x}"), F.col("comp").alias(x)) for x in ("ca", "cb"))
    between = links.join(a, F.col("u") == F.col("_ca")).join(b, F.col("v") == F.col("_cb")).select(F.col("ca").alias("u"), F.col("cb").alias("v"))
    roots = components(between)
    comp = comp.join(roots, F.col("comp") == F.col("vertex"), "left").select("v", F.coalesce("root", "comp").alias("comp"))
    return materialise(comp, "set-components")


def forest(at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """at (sig, v, n, own): buckets; sets (v, n, toks, sketch) -> v, comp: components of the links within buckets."""
    comp = at.select("v", F.col("v").alias("comp")).distinct()
    comp = materialise(comp, "set-components")

    def unsettled(*more: Column) -> tuple[DataFrame, DataFrame]:
        m = at.join(comp, "v")
        return m, m.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), *more).filter("_lo < _hi").drop("_lo", "_hi")

    for i in range(ROUNDS):
        h = F.xxhash64("v", F.lit(i))
        first = F.struct(F.col("own"), h) if i == 0 else F.struct(h)  # sets of few tokens of their own are in the middle of their group
        m, pivots = unsettled(F.min(F.struct(first.alias("h"), F.col("v").alias("a"), F.col("n").alias("m"), F.col("comp").alias("c"))).alias("p"))
        tried = m.join(pivots, "sig").filter((F.col("comp") != F.col("p.c")) & _alike(F.col("n"), F.col("p.m"), percent))
        pairs = tried.groupBy(F.col("v").alias("b")).agg(F.min("p").alias("p")).select(F.col("p.a").alias("a"), "b")
        comp = _merged(comp, _links(pairs, sets, percent))
    m, left = unsettled(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("salts"))
    m = materialise(m.join(left, "sig"), "unsettled")
    own = m.groupBy("v").agg(F.sort_array(F.collect_list("sig")).alias("sigs")).join(sets.select("v", "sketch"), "v")
    m = m.join(own, "v").withColumn("earlier", F.filter("sigs", lambda x: x < F.col("sig")))
    m = m.select("sig", "v", "n", "comp", "sketch", "earlier", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    m = m.withColumn("home", F.col("_own") == F.col("salt")).drop("_own").repartition("sig", "salt").sortWithinPartitions("sig", "salt", F.desc("home"))
    pairs = shipped(m).mapInArrow(_crossed(percent), "a long, b long").distinct()
    return _merged(comp, _links(pairs, sets, percent))


def _indexed(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The buckets (sig, v, n, own: tokens that no other set is known to have) with two sets or more, and the sets in them."""
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    least = reps.select("v", "n", F.explode("least").alias("token"))
    often = least.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    often = materialise(often, "shared-tokens")
    known = reps.select("v", "n", "_h", "_g", (F.size("least") - need).alias("spare"))

    def heavy(shared: DataFrame) -> DataFrame:
        """Sets without need tokens of their own among those counted."""
        per = shared.groupBy("v").agg(F.count(F.lit(1)).alias("shared"))
        return known.join(per, "v").filter("shared > spare")

    shared = materialise(looked_up(least.select("v", "token"), "token", often, often.select("token", F.col("c").alias("n"))).select("v", "token"), "shared-places")
    first = materialise(heavy(shared).select("v", "_h", "_g"), "heavy-sets")
    sets = _sets(docs, first, width)
    again = sets.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    counts = materialise(often.unionByName(again).groupBy("token").agg(F.max("c").alias("c")), "token-counts")
    extra = counts.join(often.select("token"), "token", "left_anti").select(F.col("token").alias("_t"))
    more = least.select("v", "token").join(sized(materialise(extra, "more-shared"), _SENT), F.col("token") == F.col("_t")).select("v", "token")
    second = heavy(shared.unionByName(more)).join(first.select("v"), "v", "left_anti").select("v", "_h", "_g")
    sets = sets.unionByName(_sets(docs, materialise(second, "heavy-sets"), width))
    level = F.when(F.col("c") >= COMMON, 3).when(F.col("c") >= RARE, 2).when(F.col("c") > 1, 1).otherwise(0).alias("level")
    toks = sets.select("v", "n", F.explode("toks").alias("token")).join(counts, "token", "left")
    ordered = toks.groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct(level, "token"))).alias("ordered"))
    signed = materialise(shipped(ordered).mapInArrow(_signed(percent), "sig long, v long, n long, own long, lone boolean"), "signatures")
    # a light set's prefix: tokens of its own, which only heavy ones may have besides
    alone = signed.filter("lone").select(F.col("sig").alias("_t")).distinct()
    light = least.join(sized(materialise(alone, "lone-signatures"), _SENT), F.col("token") == F.col("_t")).select(F.col("token").alias("sig"), "v", "n", F.col("n").alias("own"))
    light = materialise(light.join(sets.select("v"), "v", "left_anti"), "light-signatures")
    at = signed.drop("lone").unionByName(light)
    shared = at.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("sig")
    met = light.select("v").distinct().join(known, "v").select("v", "_h", "_g")
    return materialise(at.join(shared, "sig", "left_semi"), "buckets"), sets.unionByName(_sets(docs, met, width))


def join_documents(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    tells = F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "text").alias("_g")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), tells)
    kinds = docs.select("doc_id", "_h", "_g").schema.add("n", "long").add("k1", "long").add("k2", "long").add("least", ArrayType(LongType()))
    rows = materialise(shipped(docs).mapInArrow(_scan(width, percent), kinds), "shingled")
    key = F.struct("k1", "k2").alias("key")
    reps = rows.filter("n > 0").groupBy(key, "n").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h", "_g")).alias("of"), F.first("least").alias("least"), F.count(F.lit(1)).alias("rows")
    )
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("v"), "key", "n", "least", "rows", F.col("of.none").alias("none"), F.col("of.doc_id").alias("doc_id"), "of._h", "of._g"), "set-classes")
    at, sets = _indexed(docs, reps, width, percent)
    comp = forest(at, sets, percent).withColumnRenamed("v", "_v")
    named = reps.join(comp, F.col("v") == F.col("_v"), "left").select("key", "rows", "none", "doc_id", F.coalesce("comp", "v").alias("comp"))
    named = materialise(named, "classes-named")
    of = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_key = looked_up(named.select("comp", "key"), "comp", of).select("key", "component_id")
    full = looked_up(rows.filter("n > 0").select("doc_id", "n", key), "key", by_key, named.select("key", F.col("rows").alias("n")))
    empty = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n", "component_id").unionByName(empty).withColumnRenamed("n", "n_shingles")


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


#: Links from shared shingles, then the smallest id that links lead to, spread until nothing changes.
OP11_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, least(len(w), 1) + 1))) AS i FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM documents
  UNION
  SELECT l.v, r.c FROM r JOIN l ON l.u = r.v WHERE r.c < l.v
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.v = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
