"""Query-log statistics: a log has ts, query_id, latency_ms, n_results, failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise

ROLLING = 100
_CHUNK = 10_000


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """df with _part, the number of the range of `by` that a row lies in: ranges are of like size, taken from
    a sample, and rows of one range are one task's. Written, so that the ranges stay."""
    return materialise(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranged")


def numbered(log: DataFrame) -> DataFrame:
    """log with n, its place by (ts, query_id) from 1: counts by range, then places within the range."""
    d = ranged(log, "ts", "query_id")
    per = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    per = per.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("ts", "query_id"))
    d = d.withColumn("_own", own).join(F.broadcast(per), F.col("_part") == F.col("_p"))
    return d.withColumn("n", F.col("_before") + F.col("_own")).drop("_part", "_p", "_own", "_before")


def rolling_latency(log: DataFrame, last: int = ROLLING) -> DataFrame:
    """query_id, mean latency of the last successes up to and with it. The places are cut into
    chunks, each with the `last` - 1 rows before it, so that no task sorts the whole log."""
    d = numbered(log.filter(~F.col("failed")))
    chunk = F.floor((F.col("n") - 1) / _CHUNK)
    reach = F.floor((F.col("n") - 2 + last) / _CHUNK)
    d = d.withColumn("_own", chunk).withColumn("_c", F.explode(F.sequence(chunk, reach)))
    w = Window.partitionBy("_c").orderBy("n").rowsBetween(1 - last, 0)
    return d.withColumn("m", F.avg("latency_ms").over(w)).filter("_c = _own").select("query_id", F.round("m", 9).alias("rolling_ms"))


def running_latency(log: DataFrame) -> DataFrame:
    """query_id, and up to it: successes, least and largest latency. Two levels: ranges, then within."""
    d = ranged(log.filter(~F.col("failed")), "ts", "query_id")
    per = d.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    per = per.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.min("lo").over(before).alias("_lo"), F.max("hi").over(before).alias("_hi"))
    w = Window.partitionBy("_part").orderBy("ts", "query_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_own": F.count(F.lit(1)).over(w), "_min": F.min("latency_ms").over(w), "_max": F.max("latency_ms").over(w)})
    d = d.join(F.broadcast(per), F.col("_part") == F.col("_p"))
    return d.select("query_id", (F.col("_n") + F.col("_own")).alias("successes"), F.least("_lo", "_min").alias("min_ms"), F.greatest("_hi", "_max").alias("max_ms"))


def places(log: DataFrame, *by: str) -> DataFrame:
    """by, the distinct latencies v, how many rows have one of them or a lesser one (upto), and all rows (n).

    Exact, and no task holds a whole group: equal latencies are counted first, ranges of them
    added up, then the latencies within a range.
    """
    counts = ranged(log.filter(F.col("latency_ms").isNotNull()).groupBy(*by, F.col("latency_ms").alias("v")).agg(F.count(F.lit(1)).alias("c")), *by, "v")
    per = counts.groupBy(*by, "_part").agg(F.sum("c").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # rows: ranges of the group
    per = per.select(*[F.col(x).alias(f"_{x}") for x in by], F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("n"))
    same = F.col("_part") == F.col("_p")
    for x in by:
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    own = Window.partitionBy(*by, "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    d = counts.withColumn("_own", F.sum("c").over(own)).join(per, same)
    return d.select(*by, "v", (F.col("_before") + F.col("_own")).alias("upto"), "n")


def _between(at: Column, top: int = 0) -> Column:
    """Over rows of places(): linear between the places around at, counted from 1, the lower one at most n - top."""
    j = F.least(F.greatest(F.floor(at), F.lit(1)), F.greatest(F.col("n") - top, F.lit(1)))
    low, high = F.min(F.when(F.col("upto") >= j, F.col("v"))), F.min(F.when(F.col("upto") >= j + 1, F.col("v")))
    part = F.max(at - j)
    return F.when((part == 0) | high.isNull(), low).otherwise(low + part * (high - low))


def percentile(p: float) -> Column:
    """Linear between places 1 + p (n - 1)."""
    return _between(p * (F.col("n") - 1) + 1)


def exclusive_percentile(p: float, least: int) -> Column:
    """Linear between places p (n + 1), kept within the ends; below `least` rows the largest."""
    return F.when(F.max("n") >= least, _between(F.lit(p) * (F.col("n") + 1), 1)).otherwise(F.max("v"))


def system_stats(log: DataFrame) -> DataFrame:
    """Totals, rates and extremes of the whole log; failures have no latency."""
    ok = F.when(~F.col("failed"), F.col("latency_ms"))
    return log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed"), F.round(F.count_if(~F.col("failed")) / F.count(F.lit(1)), 6).alias("success_rate"),
        F.round(F.avg(F.when(~F.col("failed"), F.col("n_results"))), 6).alias("avg_results"), F.min(ok).alias("min_ms"), F.max(ok).alias("max_ms"),
    )


def _with(stats: DataFrame, more: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """stats and more of each group; one row each where there are no groups."""
    if not by:
        return stats.crossJoin(more)
    same = F.lit(True)
    for x in by:
        more = more.withColumnRenamed(x, f"_{x}")
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    return stats.join(more, same, "left").drop(*[f"_{x}" for x in by])


def latency_summary(log: DataFrame, *by: str) -> DataFrame:
    """Mean, median, extremes, sample deviation, and p95 and p99 by the exclusive method: from 20 and
    100 samples on, else the largest. Quantiles come from counts of distinct values, not from rows."""
    ok = F.when(~F.col("failed"), F.col("latency_ms"))
    tails = places(log.filter(~F.col("failed")), *by).groupBy(*by).agg(
        F.round(percentile(0.5), 6).alias("median_ms"), F.round(exclusive_percentile(0.95, 20), 6).alias("p95_ms"), F.round(exclusive_percentile(0.99, 100), 6).alias("p99_ms")
    )
    base = log.groupBy(*by).agg(
        F.count_if(~F.col("failed")).alias("n"), F.count_if("failed").alias("n_failed"), F.round(F.avg(ok), 6).alias("mean_ms"),
        F.min(ok).alias("min_ms"), F.max(ok).alias("max_ms"), F.round(F.stddev_samp(ok), 6).alias("std_ms"),
    )
    return _with(base, tails, by)


def latency_percentiles(log: DataFrame, *by: str) -> DataFrame:
    """Mean, p50, p95, linear between places, rounded to 2."""
    tails = places(log, *by).groupBy(*by).agg(F.round(percentile(0.5), 2).alias("p50_ms"), F.round(percentile(0.95), 2).alias("p95_ms"))
    return _with(log.groupBy(*by).agg(F.round(F.avg("latency_ms"), 2).alias("mean_ms")), tails, by)


#: Size of a quantile sketch, and the rank error that its quantiles keep to, merged or not, as a share of the rows.
SKETCH, SKETCH_ERROR = 1024, 0.006


def daily_sketches(log: DataFrame, *by: str) -> DataFrame:
    """by, day, n, and a mergeable sketch of the successes' latencies: a row a day, some kilobytes, whatever the log's size."""
    ok = log.filter(~F.col("failed") & F.col("latency_ms").isNotNull()).withColumn("day", F.to_date("ts"))
    return ok.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(SKETCH)).alias("sketch"))


def sketched_percentiles(days: DataFrame, ps: tuple[float, ...] = (0.5, 0.95, 0.99), *by: str) -> DataFrame:
    """by, n, p, v: of any days of daily_sketches, merged, values of about rank p, within SKETCH_ERROR."""
    all_ = days.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s")).filter("n > 0")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias("v")) for p in ps])).alias("_x")
    return all_.select(*by, "n", each).select(*by, "n", "_x.p", "_x.v")


def timing_stats(log: DataFrame, *by: str) -> DataFrame:
    """Mean, both deviations, extremes, p95."""
    base = log.groupBy(*by).agg(
        F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.round(F.stddev_samp("latency_ms"), 6).alias("std_sample"), F.round(F.stddev_pop("latency_ms"), 6).alias("std_population"),
        F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"),
    )
    return _with(base, places(log, *by).groupBy(*by).agg(F.round(percentile(0.95), 6).alias("p95_ms")), by)


def grade(value: Column, target: Column | float) -> Column:
    """A+ to F by the ratio to a target."""
    r = value / target
    return F.when(r >= 1.1, "A+").when(r >= 1.0, "A").when(r >= 0.9, "B").when(r >= 0.75, "C").when(r >= 0.5, "D").otherwise("F")


def overall_grade(share: Column) -> Column:
    """A+ to F by a share of passed checks."""
    return F.when(share >= 0.9, "A+").when(share >= 0.8, "A").when(share >= 0.7, "B").when(share >= 0.6, "C").when(share >= 0.5, "D").otherwise("F")


def overall_grades(checks: DataFrame, *by: str) -> DataFrame:
    """by, the share of passed checks and its grade. checks: passed, a boolean; null counts as failed."""
    share = F.avg(F.coalesce(F.col("passed"), F.lit(False)).cast("double"))
    return checks.groupBy(*by).agg(F.round(share, 6).alias("score"), overall_grade(share).alias("grade"))


def experiment_counts(results: DataFrame) -> DataFrame:
    """One row: how many results succeeded and failed, and the queries a second of the ones that did.

    results: error, null where there was none; processed; seconds and build_seconds.
    """
    ok, took = F.col("error").isNull(), F.col("seconds") - F.col("build_seconds")
    return results.agg(
        F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        F.round(F.try_divide(F.sum(F.when(ok, F.col("processed"))), F.sum(F.when(ok, took))), 6).alias("queries_per_second"),
    )


def recommendations(checks: DataFrame, advice: dict[tuple[str, str], str], least: float = 0.8, general: str = "Begin with the components of the lowest scores.") -> DataFrame:
    """text of the advice for each failed check, and the general one where fewer than `least` of all passed.

    checks: component, check, passed. A check that failed twice is advised once; one without advice not.
    """
    spark = checks.sparkSession
    known = spark.createDataFrame([(c, k, t) for (c, k), t in advice.items()], "_component string, _check string, text string")
    failed = checks.filter(~F.coalesce("passed", F.lit(False))).select("component", "check").distinct()
    own = failed.join(F.broadcast(known), (F.col("component") == F.col("_component")) & (F.col("check") == F.col("_check"))).select("component", "text")
    low = checks.agg(F.avg(F.coalesce(F.col("passed"), F.lit(False)).cast("double")).alias("_s")).filter(F.col("_s") < least)
    return own.unionByName(low.select(F.lit("general").alias("component"), F.lit(general).alias("text")))


def speedup(timings: DataFrame, baseline: str) -> DataFrame:
    """method, median_ms, how many times faster than the baseline. timings: method, latency_ms."""
    m = materialise(places(timings, "method").groupBy("method").agg(percentile(0.5).alias("m")), "medians")
    b = m.filter(F.col("method") == baseline).select(F.col("m").alias("_b"))
    return m.join(F.broadcast(b)).select("method", F.round("m", 6).alias("median_ms"), F.round(F.try_divide("_b", "m"), 6).alias("speedup"))


def best_method(timings: DataFrame, *by: str) -> DataFrame:
    """by, the method of least mean time (ties by name), that mean."""
    m = timings.groupBy(*by, "method").agg(F.round(F.avg("latency_ms"), 6).alias("mean_ms"))
    best = m.groupBy(*by).agg(F.min(F.struct("mean_ms", "method")).alias("b"))
    return best.select(*by, F.col("b.method").alias("method"), F.col("b.mean_ms").alias("mean_ms"))
