"""Joins with a contract: multiplicity, unmatched rows, membership and metric comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.operators.checks import key_violations


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """Inner join and a scalar telling whether both sides have unique, non-null keys."""
    broken = key_violations(a, keys).select(*keys).unionByName(key_violations(b, keys).select(*keys))
    ok = broken.agg(F.count(F.lit(1)) == 0).scalar()
    return a.join(b, keys), ok


def left_with_unmatched(
    a: DataFrame, b: DataFrame, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(matched rows with the right columns, left rows without a partner)."""
    return a.join(b, keys), a.join(b.select(*keys).distinct(), keys, "left_anti")


def compare_metric_tables(
    a: DataFrame, b: DataFrame, keys: list[str], values: list[str]
) -> DataFrame:
    """Largest absolute difference per metric over the common keys."""
    x = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values])
    y = b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values])
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.max(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}"))).alias(v) for v in values
    ]
    rows = F.array(
        *[F.struct(F.lit(v).alias("metric"), F.col(v).alias("max_difference")) for v in values]
    )
    return (
        x.join(y, keys)
        .agg(*aggs)
        .select(F.col("_n").alias("n_compared"), F.explode(rows).alias("_r"))
        .select("n_compared", "_r.*")
    )
