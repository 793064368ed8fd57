"""Streaming extensions: a monitored query log, and documents that keep arriving."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.index import term_counts


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files of query events, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(log: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts and latencies of each window; events later than `late` are left out."""
    ok = F.when(~F.col("failed"), F.col("latency_ms"))
    return log.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed"), F.avg(ok).alias("mean_ms"), F.max(ok).alias("max_ms")
    )


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no more than gap apart."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def append_postings(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Index arriving documents (doc_id, text): each batch's postings go to a folder of its own number,
    so that a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        term_counts(batch, "doc_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Rolling(StatefulProcessor):
    """Of each key the successes that may still be overtaken, and the latencies before them that a mean reaches back to."""

    def __init__(self, key: str, last: int):
        self.key, self.last = key, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ts timestamp, query_id long, latency_ms double")
        self.before = handle.getListState("before", "latency_ms double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(r.ts.to_pydatetime(), int(r.query_id), float(r.latency_ms)) for d in rows for r in d.itertuples(index=False)]
        if new:
            self.pending.appendList(new)
            self._wake(min(t for t, _, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed a row: nothing earlier can come, so it and all before it are settled."""
        reached = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.pending.get())
        n = sum(_ms(t) <= reached for t, _, _ in rows)
        held, out = [r[0] for r in self.before.get()], []
        for _, query_id, latency in rows[:n]:
            held = [*held, latency][-self.last :]
            out.append((key[0], query_id, math.fsum(held) / len(held)))
        held = held[1 - self.last :] if self.last > 1 else []
        self.before.put([(x,) for x in held]) if held else self.before.clear()
        self.pending.put(rows[n:]) if rows[n:] else self.pending.clear()
        if rows[n:]:
            self._wake(rows[n][0])
        if out:
            yield pd.DataFrame(out, columns=[self.key, "query_id", "rolling_ms"])

    def _wake(self, at) -> None:
        self.handle.registerTimer(_ms(at))

    def close(self) -> None:
        """Nothing is held outside of the state."""


def _ms(t) -> int:
    return int(pd.Timestamp(t, tz="UTC" if pd.Timestamp(t).tzinfo is None else None).timestamp() * 1000)


def rolling(log: DataFrame, by: str = "user_id", last: int = 100, late: str = "10 minutes") -> DataFrame:
    """by, query_id, rolling_ms: of each success the mean latency of its key's last ones by (ts, query_id), up to and with it.

    A row is emitted once the watermark has passed it, in the order of time, whatever the order of arrival; successes later than
    `late` are left out. The state of a key is what the watermark hasn't reached and last - 1 latencies. Needs the RocksDB state
    store (`spark.sql.streaming.stateStore.providerClass`).
    """
    ok = log.filter(~F.col("failed")).withWatermark("ts", late).select(by, "ts", "query_id", F.col("latency_ms").cast("double").alias("latency_ms"))
    kinds = StructType([log.schema[by]]).add("query_id", "long").add("rolling_ms", "double")
    return ok.groupBy(by).transformWithStateInPandas(_Rolling(by, last), kinds, "append", "eventTime")
