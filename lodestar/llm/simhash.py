"""SimHash near-duplicates by anchor-point covering.

Fingerprints: majority bits of the XXH64 (seed 42) of all word shingles.
A text of fewer words than a shingle has one shingle, its words; a text of
none, or a null one, has fingerprint 0 and is linked like any other. Repeated
rows share fingerprint and component. An empty table gives an empty one.

Linking: 64 bits are cut into three fields of 22, 21 and 21 bits, so two
fingerprints at distance 4 or less differ in at most one bit of some field. Beyond MANY fingerprints
there are two fields of 32 bits and two differing bits of one: more replicas, but far fewer members an
anchor; links are the same either way.
The anchors of a field are the words of a covering code of radius 1: the
Hamming(7,4) code on its first 7 bits, everything on the rest. A fingerprint
is at home at the one anchor within radius 1, and is replicated to every anchor,
within radius + threshold, that is home to a word at the threshold's distance or less. At each anchor the
members at home are compared with all replicas. Anchors with very many
members are split by salting those at home; the replicas go to every salt.
At an anchor only a spanning forest of the links is kept, never all pairs.

Of one component the smallest id counts, null ones last; ids may repeat. Texts of any length are
taken whole; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, shipped, table
from .components import components
from .joins import looked_up
from .scan import slices

SHINGLE = 4
DISTANCE = 4
#: Bit and width of the fields, and how many bits may differ in one of them.
FIELDS, RADIUS = ((0, 22), (22, 21), (43, 21)), 1
WIDE_FIELDS, WIDE_RADIUS = ((0, 32), (32, 32)), 2
#: Distinct fingerprints beyond which fields are wide: replicas then cost less than comparisons.
MANY = 1 << 30
#: Members of an anchor beyond which those at home are salted, this many to a salt.
HOT = 20_000
_BLOCK = 1 << 22

#: Majority votes are counted over so many hashes at a time.
_VOTES = 1 << 15


def _fingerprint(text: bytes, n: int, h=xxhash.xxh64_intdigest) -> int:
    words = text.lower().split()  # bytes: A-Z only, and exactly the six separators
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return h(joined, 42)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *[e + 1 for e in ends[: len(words) - n]]]
    ends = [*ends[n - 1 :], len(joined)]
    hashes = np.fromiter([h(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)], np.uint64, len(starts))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _VOTES):
        votes += np.unpackbits(hashes[i : i + _VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keep: str, n: int = SHINGLE) -> DataFrame:
    """keep and fp, the fingerprint as a signed long."""
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                fp = np.array([_fingerprint(t or b"", n) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(fp)], names=[*keep, "fp"])

    return shipped(docs.select(*keep, "text")).mapInArrow(run, schema)


def _hamming() -> list[int]:
    """The 16 words of the Hamming(7,4) code: bit positions 1 to 7 whose set ones XOR to 0."""
    words = []
    for w in range(128):
        s = 0
        for i in range(7):
            if w >> i & 1:
                s ^= i + 1
        if s == 0:
            words.append(w)
    return words


def _code(most: int) -> tuple[list[int], list[list[list[int]]]]:
    """For each 7-bit word its nearest code word, and for distances 0 to most those of all words so near."""
    code = _hamming()
    near = [min(code, key=lambda c: (c ^ w).bit_count()) for w in range(128)]
    return near, [[sorted({near[v] for v in range(128) if (v ^ w).bit_count() <= d}) for w in range(128)] for d in range(most + 1)]


def _anchors(fp: Column, fields: tuple[tuple[int, int], ...] = FIELDS, radius: int = RADIUS) -> Column:
    """Array of (anchor, home): where fp is at home and where it is replicated to."""
    near, reach = _code(radius)
    near, reach = F.array(*[F.lit(x) for x in near]), [F.array(*[F.array(*[F.lit(y) for y in x]) for x in r]) for r in reach]
    out = []
    for f, (shift, width) in enumerate(fields):
        v = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        coded, free = v.bitwiseAND(F.lit(127)).cast("int"), F.shiftrightunsigned(v, 7)

        def anchor(c: Column, r: Column, tag: int = f << 40) -> Column:
            return F.lit(tag).bitwiseOR(F.shiftleft(r, 7)).bitwiseOR(c.cast("long"))

        home, parts = anchor(F.get(near, coded), free), []
        for j in range(radius + 1):  # j bits differ in the free part, the others in the coded one
            flips = [sum(1 << i for i in x) for x in combinations(range(width - 7), j)]
            flips = F.array(*[F.lit(m).cast("long") for m in flips])
            coded_near = F.get(reach[radius - j], coded)
            parts.append(F.flatten(F.transform(flips, lambda m: F.transform(coded_near, lambda w: anchor(w, free.bitwiseXOR(m))))))  # noqa: B023
        out.append(F.array(F.struct(home.alias("anchor"), F.lit(True).alias("home"))))
        away = F.filter(F.concat(*parts), lambda a: a != home)  # noqa: B023
        out.append(F.transform(away, lambda a: F.struct(a.alias("anchor"), F.lit(False).alias("home"))))
    return F.concat(*out)


def _forest(fps: np.ndarray, home: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest over one anchor's members; those at home are compared with all.

    A member that a found link reaches isn't compared again with what is reached already.
    """
    rest = np.arange(len(fps))
    todo = set(np.flatnonzero(home).tolist())
    while todo:
        first = todo.pop()
        own, queue = [first], [first]
        left = rest[rest != first]
        while queue:
            x = queue.pop()
            hit = np.bitwise_count(fps[left] ^ fps[x]) <= t
            if hit.any():
                got = left[hit]
                yield np.full(len(got), fps[x]), fps[got]
                left = left[~hit]
                got = got[home[got]].tolist()
                todo.difference_update(got)
                own += got
                queue += got
        # replicas stay: other components at home here may reach them too
        rest = np.setdiff1d(rest, np.array(own), assume_unique=True)


def _compare(t: int):
    """Over rows sorted by (anchor, salt): the links at each anchor."""

    def links(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(anchor)) + 1
        lo = np.concatenate([[0], cut])
        hi = np.concatenate([cut, [len(anchor)]])
        n_home = np.add.reduceat(home.astype(np.int64), lo)
        us, vs = [], []
        small = (n_home > 0) & (hi - lo > 1) & (n_home * (hi - lo) <= 4096)
        rows = np.flatnonzero(home & np.repeat(small, hi - lo))
        if len(rows):  # many small anchors: all their comparisons at once
            g = np.searchsorted(lo, rows, "right") - 1
            size = hi[g] - lo[g]
            for i in range(0, len(rows), 1 << 14):
                s, r, at = size[i : i + (1 << 14)], rows[i : i + (1 << 14)], lo[g[i : i + (1 << 14)]]
                left = np.repeat(r, s)
                right = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(at, s)
                hit = (np.bitwise_count(fps[left] ^ fps[right]) <= t) & (left != right)
                us.append(fps[left[hit]])
                vs.append(fps[right[hit]])
        for i in np.flatnonzero((n_home > 0) & (hi - lo > 1) & ~small):
            for u, v in _forest(fps[lo[i] : hi[i]], home[lo[i] : hi[i]], t):
                us.append(u)
                vs.append(v)
        if us:
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("anchor").to_numpy() * 4096 + b.column("salt").to_numpy()
            new = (key, b.column("fp").to_numpy().view(np.uint64), b.column("home").to_numpy(zero_copy_only=False))
            last = int(np.searchsorted(key, key[-1]))  # the last anchor may go on in the next batch
            if held and held[-1][0][-1] == key[-1] and last == 0:
                held.append(new)
                continue
            done = [*held, tuple(x[:last] for x in new)]
            held = [tuple(x[last:] for x in new)]
            done = [np.concatenate(x) for x in zip(*done, strict=True)]
            if len(done[0]):
                yield from links(*done)
        if held:
            yield from links(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def link_fingerprints(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct fp long -> u, v: links whose components are those of all pairs within distance."""
    if distance > DISTANCE:
        raise ValueError(f"the fields are cut for a distance of {DISTANCE} or less")
    wide = fps.count() > MANY
    at = fps.select("fp", F.inline(_anchors(F.col("fp"), *((WIDE_FIELDS, WIDE_RADIUS) if wide else (FIELDS, RADIUS)))))
    hot = at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    hot = materialise(hot.select(F.col("anchor").alias("_a"), F.least(F.ceil(F.col("n") / HOT), F.lit(4095)).cast("int").alias("salts")), "hot-anchors")
    if hot.isEmpty():
        at = at.withColumn("salt", F.lit(0))
    else:
        at = at.join(hot, F.col("anchor") == F.col("_a"), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
        # at home in one salt, compared with in all others
        at = at.select("fp", "anchor", F.col("home").alias("_h"), own.alias("_s"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        at = at.withColumn("home", F.col("_h") & (F.col("salt") == F.col("_s")))
    at = at.select("anchor", "salt", "fp", "home").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return shipped(at).mapInArrow(_compare(distance), "u long, v long")


def _linked(docs: DataFrame, keep: tuple[str, ...], least: Column, n: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The rows' keep and fp, and of each distinct fp its least, an aggregate of keep, and the root that links lead to."""
    rows = materialise(fingerprints(docs, *keep, n=n), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(least.alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    links = link_fingerprints(fps.select("fp"), distance)
    roots = components(links)
    named = fps.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    return rows, materialise(named, "fingerprint-roots")


def cluster(docs: DataFrame, n: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links lead to."""
    rows, named = _linked(docs, ("doc_id",), F.min("doc_id"), n, distance)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = looked_up(named.select("root", "fp"), "root", least).select("fp", "component_id")
    return looked_up(rows, "fp", by_fp, named.select("fp", "n")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, n: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, with their columns: of each component one, that of the smallest doc_id.

    A row belongs to the component of its own text, whatever its id: rows that share an id but not a
    component stay both, and those whose id is null come after all others of their component. Of
    one id the text with the least hash stays.
    """
    def told(h: Column | str, g: Column | str) -> Column:
        """A string: a struct would be cast for the join, as a table's fields are nullable, and the join's partitioning be lost."""
        return F.concat_ws("/", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in (h, g)]).alias("_id")

    # 128 bits that tell id and text
    text, both = F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "text").alias("_g")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h", "_g"))
    rows, named = _linked(docs.select("doc_id", "text", text, both), ("doc_id", "_h", "_g"), first, n, distance)
    keep = named.groupBy("root").agg(F.min("least").alias("_k")).select(told("_k._h", "_k._g"))
    boxed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_row"), told(text, both))
    counts = rows.groupBy(told("_h", "_g")).agg(F.count(F.lit(1)).alias("n"))
    kept = looked_up(boxed, "_id", materialise(keep, "kept-rows"), counts, lambda d: d.groupBy("_id").agg(F.first("_row").alias("_row")))
    return kept.select("_row.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    d = cluster(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
