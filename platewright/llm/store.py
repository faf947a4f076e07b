"""Written tables in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from platewright.operators.stability import scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    The table is computed once, has known sizes for join planning, and does not depend on any executor.
    The folder belongs to the session's checkpoint directory and lives as long as that does.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
