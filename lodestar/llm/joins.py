"""Joins with a table of few rows a key, where a few keys may hold most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

#: Keys with more than this share of all rows, fewer than so many by arithmetic, are sent to where the rows are.
SHARE = 2000


def looked_up(rows: DataFrame, key: str, lookup: DataFrame, counts: DataFrame | None = None, then: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """rows inner-joined with lookup, whose rows for each key are one or bounded.

    Keys of more than 1 / SHARE of the rows are few, so their part of lookup is broadcast and their rows stay
    where they are; the others meet in a shuffle, in which none weighs much. counts: key, n, where
    the rows of each key are counted already; else rows, a table, is read to count them. lookup is read twice. then: what is to
    be done with the joined rows key by key, before those of frequent keys meet the others, so that the join's partitioning serves it.
    """
    if counts is None:
        counts, total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(key, "_key"), rows.count()
    else:
        counts = materialise(counts.select(F.col(key).alias("_key"), "n"), "key-counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
    hot = materialise(counts.filter(F.col("n") * SHARE > total).filter(F.col("n") > SHARE).select("_key"), "hot-keys")
    if hot.isEmpty():
        return then(rows.join(lookup, key))
    hot = F.broadcast(hot)
    sent = F.broadcast(lookup.join(hot, F.col(key) == F.col("_key"), "left_semi"))
    rest = rows.join(hot, F.col(key) == F.col("_key"), "left_anti").join(lookup, key)
    return then(rows.join(sent, key)).unionByName(then(rest))
