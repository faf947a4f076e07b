"""Numeric column access with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_or_default(df: DataFrame, name: str, default: float | None = None) -> Column:
    """The column as double (NULL where it does not parse), or a constant when it is absent."""
    if name in df.columns:
        return F.col(name).cast("string").try_cast("double")
    return F.lit(default).cast("double")
