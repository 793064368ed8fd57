"""Sharding by Karmarkar-Karp differencing, under the law `bytes`.

Documents of equal text form one indivisible group. Differencing starts with
each group as a partial partition of its own and combines, again and again, the
two of the largest spread, in opposite order.

The groups above 1 / (n_shards * LARGE) of all bytes, fewer than n_shards * LARGE by
arithmetic, are differenced first, into one partial partition. The others are
dealt by hash over leaves of about LEAF_GROUPS; every leaf takes its share of
that partition as one more to difference, so that what it adds evens out the
large groups too, and the sum over all leaves is even. No task holds
more than a leaf.

A null text counts as an empty one: both are one group, of 16 bytes a row.
Repeated rows get slots of their own; ids may repeat or be null. An empty table gives an empty one, texts of
any length count whole, and other columns play no part, whatever their names. A group larger than a fair share stays
whole: its shard holds little else.
"""

from __future__ import annotations

import heapq
import math
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise, shipped, table
from .joins import looked_up

N_SHARDS = 40
OVERHEAD = 16
LEAF_GROUPS = 50_000
LARGE = 64


def difference(singles: list[tuple[int, object]], k: int, part: tuple[list[int], list[list]] | None = None) -> tuple[list[int], list[list]]:
    """Combine weighted members, and a partial partition of k sums and k lists of members, into one.

    Returns k sums, ascending, and k lists of members. Single members are expanded to partial
    partitions only when their turn comes, and empty places hold no list, so memory follows the
    members and not k times them. Ties are resolved by the order given.
    """
    tick = count()
    heap: list[tuple] = []

    def push(sums: list[int], members: list[list | None]) -> None:
        order = sorted(range(k), key=sums.__getitem__)
        s = [sums[i] for i in order]
        heapq.heappush(heap, (s[0] - s[-1], next(tick), s, [members[i] for i in order]))

    def pop() -> tuple[list[int], list[list | None]]:
        spread, _, sums, members = heapq.heappop(heap)
        if sums is None:
            return [0] * (k - 1) + [-spread], [None] * (k - 1) + [[members]]
        return sums, members

    if part is not None:
        push(*part)
    heap += [(-w, next(tick), None, g) for w, g in singles]
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, am), (b, bm) = pop(), pop()
        members = []
        for x, y in zip(am, reversed(bm), strict=True):
            if x is None or y is None:
                members.append(x or y)
                continue
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            members.append(x)
        push([x + y for x, y in zip(a, reversed(b), strict=True)], members)
    if not heap:
        return [0] * k, [[] for _ in range(k)]
    sums, members = pop()
    return sums, [m or [] for m in members]


def _leaf(large: list[int], leaves: int):
    """Difference a leaf's groups with its share of the large ones' sums by shard."""
    k = len(large)

    def run(t: pa.Table) -> pa.Table:
        node = t["node"][0].as_py()
        order = [(i + node) % k for i in range(k)]  # ties fall to other shards in every leaf
        share = ([large[i] // leaves for i in order], [[i] for i in order])
        rows = sorted(zip(t["weight"].to_pylist(), t["group_key"].to_pylist(), strict=True), reverse=True)
        _, members = difference(rows, k, share)
        keys, shards = [], []
        for m in members:
            own = next(x for x in m if isinstance(x, int))
            keys += [x for x in m if not isinstance(x, int)]
            shards += [own] * (len(m) - 1)
        return pa.table({"group_key": pa.array(keys, pa.string()), "shard": pa.array(shards, pa.int32())})

    return run


def assign_groups(groups: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """group_key string, weight long -> group_key, shard."""
    groups = groups.select("group_key", "weight")
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    above = F.col("weight") * (n_shards * LARGE) > total
    large = groups.filter(above).collect()  # fewer than n_shards * LARGE rows
    sums, members = difference(sorted(((r.weight, r.group_key) for r in large), reverse=True), n_shards)
    placed = groups.sparkSession.createDataFrame([(g, i) for i, m in enumerate(members) for g in m], "group_key string, shard int")
    leaves = max(1, math.ceil(n / LEAF_GROUPS))
    dealt = groups.filter(~above).withColumn("node", F.pmod(F.xxhash64("group_key"), F.lit(leaves)).cast("long"))
    return materialise(shipped(dealt).groupBy("node").applyInArrow(_leaf(sums, leaves), "group_key string, shard int").unionByName(placed), "shard-leaves")


def group_keys(docs: DataFrame, *keep) -> DataFrame:
    """keep, size, text_crc32 and group_key, a SHA-256 of the text."""
    t = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        *keep, (F.length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.sha2(t, 256).alias("group_key")
    )


def _slots(d: DataFrame, rows: int) -> DataFrame:
    """Gapless slots in each shard: offsets by hash bucket, then places in the bucket. Rows that repeat id and text are told apart by
    their place in the written table (_u), so that they don't meet in one bucket."""
    n = max(1, math.ceil(rows / (N_SHARDS * LEAF_GROUPS)))
    d = d.withColumn("_b", F.pmod(F.xxhash64("doc_id", "group_key", "_u"), F.lit(n)).cast("int"))
    per = d.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = Window.partitionBy("shard", "_b").orderBy("doc_id", "group_key", "_u")
    return d.join(per, ["shard", "_b"]).withColumn("slot", F.col("_o") + F.row_number().over(place) - 1).drop("_b", "_o")


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    rows = materialise(group_keys(docs, "doc_id").withColumn("_u", F.monotonically_increasing_id()), "shard-rows")
    groups = materialise(rows.groupBy("group_key").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")), "shard-groups")
    d = looked_up(rows, "group_key", assign_groups(groups, n_shards), groups)
    return _slots(d, rows.count()).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The rows of docs, with their columns, and shard_id. Rows of one text share a shard."""
    keyed = group_keys(docs.select("text"))
    groups = materialise(keyed.groupBy("group_key").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")), "shard-groups")
    placed = assign_groups(groups, n_shards).withColumnRenamed("shard", "_shard")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    boxed = group_keys(boxed.select("_row", "_row.text"), "_row").select("_row", "group_key")
    d = looked_up(boxed, "group_key", placed, groups)
    name = "shard_id"
    while name in docs.columns:
        name = "_" + name
    return d.select("_row.*", F.col("_shard").alias(name))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    d = shard(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
