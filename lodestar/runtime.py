"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows and in bytes, that an operator hands to broadcast(); callers count first.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def shipped(df: DataFrame) -> DataFrame:
    """df, once this package is where its Python functions run: the executors get it as a zip file.

    Needed where the package is neither installed there nor on their PYTHONPATH; it is sent once
    for each application.
    """
    sc = df.sparkSession.sparkContext
    if getattr(sc, "_lodestar_shipped", None) is None:
        at = Path(tempfile.mkdtemp(prefix="lodestar-")) / "lodestar_package.zip"
        own = Path(__file__).parent
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(own.rglob("*.py")):
                z.write(f, f"{own.name}/{f.relative_to(own)}")
        sc.addPyFile(str(at))
        sc._lodestar_shipped = str(at)
    return df


def session(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df, dealt over all cores if it is below `most` bytes for each: a small table may come in one
    row group, which would leave all work on it to one task. Larger ones stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * most else df


def in_blocks(rows: DataFrame, size: Column, most: int) -> Iterator[list[Row]]:
    """The rows of a table in lists of `most` bytes at most, or of one larger row; the driver holds about two lists at a time."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    held, n = [], 0
    for r in rows.withColumn("_size", size).repartition(max(1, -(-total // most))).toLocalIterator():
        if held and n + r["_size"] > most:
            yield held
            held, n = [], 0
        held.append(r)
        n += r["_size"]
    if held:
        yield held


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    spark.checkpoint.dir names it on a cluster. Only where that is unset does a local master
    fall back to a folder of this machine; a cluster has no other folder that is surely shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/lodestar/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
