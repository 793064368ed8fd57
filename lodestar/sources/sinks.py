"""Sinks: JSON lines, one-row summaries, CSV and Markdown reports, a partitioned query log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise


def json_lines(df: DataFrame, path: str) -> None:
    """Null and empty string fields are left out."""
    slim = [F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*slim).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def json_arrays(df: DataFrame, path: str) -> None:
    """A folder of files, each one JSON array, an element a line: as many as df has partitions with rows."""

    def run(batches):
        first = True
        for b in batches:
            lines = [("[" if first and not i else ",") + x for i, x in enumerate(b.column("value").to_pylist())]
            first = first and not lines
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def query_log(log: DataFrame, path: str) -> None:
    """Appends to one folder a day."""
    log.withColumn("dt", F.to_date("ts")).write.mode("append").partitionBy("dt").json(path)


def markdown_lines(df: DataFrame) -> DataFrame:
    """ord, line of a fixed-width table: head, rule, then the rows in the order of their lines."""
    cell = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    width = df.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(x)), F.lit(0))) for c, x in zip(df.columns, cell, strict=True)]).first()
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.rpad(x, w, " ") for x, w in zip(cell, width, strict=True)]), F.lit(" |"))
    head = "| " + " | ".join(c.ljust(w) for c, w in zip(df.columns, width, strict=True)) + " |"
    top = df.sparkSession.createDataFrame([(0, head), (1, "|" + "|".join("-" * (w + 2) for w in width) + "|")], "ord long, line string")
    body = df.select(row.alias("line")).repartitionByRange("line").withColumn("_part", F.spark_partition_id())
    body = materialise(body, "report")
    per = body.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    per = per.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("line"))
    body = body.withColumn("_own", own).join(F.broadcast(per), F.col("_part") == F.col("_p"))
    return top.unionByName(body.select((F.col("_before") + F.col("_own") + 1).cast("long").alias("ord"), "line"))


def markdown(df: DataFrame, title: str) -> str:
    """A report's table as text, all its rows, fetched a part at a time."""
    rows = markdown_lines(df).orderBy("ord").toLocalIterator()
    return "\n".join([f"# {title}", "", *[r.line for r in rows], ""])
