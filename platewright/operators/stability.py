"""Reliable materialisation points on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="platewright-"))
    return sc.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: both branches of a later plan see the same partitions."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root for a written table."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet under the shared root, read back: computed once, of known size, independent of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, written, with a broadcast hint if its files hold at most ``limit`` bytes; else a shuffled join."""
    spark = df.sparkSession
    path = scratch_path(spark, "constants")
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    back = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(back) if size <= limit else back


def attach(df: DataFrame, constants: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Bring per-group constants (fold means, scales, quantiles) to the rows of ``df``.

    The constants are written once, which gives the planner their size: small ones are broadcast, so the rows stay where
    they are instead of being shuffled on a handful of keys; larger ones are joined by a shuffle.
    """
    return df.join(written(constants, "constants"), keys, how)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into a fixed number of tasks before work that is heavy per byte.

    Adaptive coalescing merges partitions by size and would leave costly groups in a few tasks. A
    following ``groupBy`` on the same keys reuses this partitioning, so no shuffle is added there.
    """
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, configured), *keys)


def spread_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash-partition a written table into a task per ``rows`` rows, so that no task grows with the table."""
    tasks = -(-df.count() // rows)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks), *keys)
