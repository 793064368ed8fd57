from __future__ import annotations

import bisect

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import monitoring as N
from lodestar.operators.index import build
from lodestar.streaming import query_log as Q

KIND = "ts timestamp, user_id long, latency_ms double, failed boolean"


def log(spark):
    return spark.range(300).select(F.timestamp_seconds(F.col("id") * 20).alias("ts"), (F.col("id") % 3).alias("user_id"), F.col("id").cast("double").alias("latency_ms"), (F.col("id") % 10 == 0).alias("failed"))


def test_windows_match_a_batch(spark, tmp_path):
    d = log(spark)
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    q = Q.windowed(Q.read_log(spark, f"{tmp_path}/in", KIND, 10)).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.total, r.failed, r.mean_ms) for r in spark.sql("SELECT * FROM w").collect()}
    ok = F.when(~F.col("failed"), F.col("latency_ms"))
    want = d.groupBy(F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed"), F.avg(ok).alias("mean_ms"))
    assert got == {(r.window.start, r.total, r.failed, r.mean_ms) for r in want.collect()}


def test_sessions(spark):
    d = log(spark).filter("user_id = 1 AND (latency_ms < 30 OR latency_ms > 200)")
    assert sorted(r.n for r in Q.sessions(d).collect()) == [10, 33]


def test_postings_of_arriving_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} the the") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    Q.append_postings(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("doc_id", "term", "tf").collect())
    assert got == sorted(tuple(r) for r in build(docs).postings.select("doc_id", "term", "tf").collect())


def test_rolling_means_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Rows come out of order, in several batches, and the stream is started anew between them."""
    d = spark.range(400).select(
        F.timestamp_seconds(F.col("id") * 20 + F.col("id") % 3).alias("ts"), (F.col("id") % 3).alias("user_id"), F.col("id").alias("query_id"), (F.col("id") * 7 % 31).cast("double").alias("latency_ms"), (F.col("id") % 10 == 0).alias("failed")
    )
    at, to = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(3):
            own = d.filter((F.col("query_id") >= 150 * part) & (F.col("query_id") < 150 * (part + 1)))
            own.orderBy(F.xxhash64("query_id")).coalesce(1).write.mode("append").parquet(at)
            if part == 2:  # a late success of all keys moves the watermark past the rest
                last = spark.range(3).select(F.timestamp_seconds(F.lit(10**6)).alias("ts"), F.col("id").alias("user_id"), (F.col("id") + 10**6).alias("query_id"), F.lit(1.0).alias("latency_ms"), F.lit(False).alias("failed"))
                last.coalesce(1).write.mode("append").parquet(at)
            q = Q.rolling(Q.read_log(spark, at, d.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), 1), last=5)
            q = q.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").format("parquet").option("path", to).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.user_id, r.query_id): r.rolling_ms for r in spark.read.parquet(to).collect() if r.query_id < 10**6}
    w = Window.partitionBy("user_id").orderBy("ts", "query_id").rowsBetween(-4, 0)
    want = {(r.user_id, r.query_id): r.m for r in d.filter(~F.col("failed")).withColumn("m", F.avg("latency_ms").over(w)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sketches_keep_to_their_error(spark):
    n = 60_000
    d = spark.range(n).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.exp(F.rand(5) * 9).alias("latency_ms"), (F.col("id") % 50 == 0).alias("failed")).cache()
    days = N.daily_sketches(d)
    assert days.count() == 7 and days.agg(F.sum("n")).first()[0] == n * 49 // 50
    some = days.filter("day >= '1970-01-03'")
    for own, from_ in ((days, 0), (some, 2 * 86400)):
        values = sorted(r.latency_ms for r in d.filter(~F.col("failed") & (F.col("ts") >= F.timestamp_seconds(F.lit(from_)))).collect())
        for r in N.sketched_percentiles(own, (0.01, 0.25, 0.5, 0.95, 0.99)).collect():
            assert r.n == len(values)
            assert abs(bisect.bisect_right(values, r.v) / len(values) - r.p) <= N.SKETCH_ERROR
    assert N.sketched_percentiles(days.limit(0)).collect() == []
