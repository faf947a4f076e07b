"""Data-quality checks. Each returns a violation table; ``fail_fast`` turns one into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions.common import decimal_comma, is_bad_double


class CheckFailed(ValueError):
    """A violation table was not empty."""


def fail_fast(violations: DataFrame, label: str, show: int = 5) -> None:
    """Raise with a few example rows; reads at most ``show`` rows."""
    rows = violations.take(show)
    if rows:
        raise CheckFailed(f"{label}: e.g. {[r.asDict() for r in rows]}")


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Schema-only check, one row per absent column."""
    gone = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame([(c,) for c in gone], "column string")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated keys and NULL keys. Partial aggregation keeps hot keys small in the shuffle."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.withColumn("problem", F.when(null_key, "null").when(F.col("n") > 1, "duplicate"))
        .where(F.col("problem").isNotNull())
    )


def pattern_violations(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).rlike(f"^(?:{pattern})$"), F.lit(False)))


def numeric_parse_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: texts, values that do not parse, and infinities. Works on decimal-comma text."""
    aggs = []
    for c in columns:
        text = F.trim(F.col(c).cast("string"))
        filled = text.isNotNull() & (text != "")
        x = decimal_comma(text)
        aggs += [
            F.count_if(filled).alias(f"_t_{c}"),
            F.count_if(filled & x.isNull()).alias(f"_u_{c}"),
            F.count_if(filled & (F.abs(x) == F.lit(float("inf")))).alias(f"_i_{c}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_t_{c}").alias("n_text"),
                F.col(f"_u_{c}").alias("n_unparsed"),
                F.col(f"_i_{c}").alias("n_infinite"),
            )
            for c in columns
        ]
    )
    return df.agg(*aggs).select(F.explode(rows).alias("_r")).select("_r.*")


def without_measurement(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n")).where(F.col("n") == 0).select(key)


def bad_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is NULL or holds a NULL, NaN or infinite value."""
    return df.where(F.coalesce(F.exists(vec, lambda x: is_bad_double(x)), F.lit(True)))


def small_groups(df: DataFrame, groups: list[str], minimum: int) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < minimum)


def large_groups(df: DataFrame, groups: list[str], maximum: int) -> DataFrame:
    """Groups too large for a dense per-group model; block them first."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > maximum)


def unknown_ids(requested: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(df.select(key), key, "left_anti")


def model_coverage(df: DataFrame, model: str, key: str) -> DataFrame:
    """Rows, distinct keys and missing keys per model against the union of all keys.

    Model sets are folded per key, so no model's key set is gathered anywhere.
    """
    per_key = df.groupBy(key, model).agg(F.count(F.lit(1)).alias("_n"))
    n_keys = df.select(key).distinct().agg(F.count(F.lit(1))).scalar()
    return (
        per_key.groupBy(model)
        .agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
        .withColumn("n_missing", n_keys - F.col("n_keys"))
        .withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_rows") == F.col("n_keys")))
    )


def agreement(
    a: DataFrame, b: DataFrame, keys: list[str], by: list[str], value: str, tolerance: float
) -> DataFrame:
    """Largest difference of a value between two tables joined on the keys."""
    joined = a.select(*by, *[k for k in keys if k not in by], F.col(value).alias("_a")).join(
        b.select(*keys, F.col(value).alias("_b")), keys
    )
    return (
        joined.groupBy(*by)
        .agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))
        .withColumn("agrees", F.col("max_difference") <= tolerance)
    )


def mismatches(df: DataFrame, declared: Column, derived: Column) -> DataFrame:
    return df.where(~F.coalesce(F.upper(F.trim(declared)) == derived, F.lit(False)))


def non_positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.col(column) <= 0, F.lit(True)))


def drift(current: DataFrame, saved: DataFrame, relative_tolerance: float) -> DataFrame:
    """Named numbers against a saved reference: PASS, FAIL, missing or new.

    Passes while |a - b| <= tolerance * max(1, |reference|).
    """
    a = current.select("name", F.col("num").alias("value"))
    b = saved.select("name", F.col("num").alias("reference"))
    gap = F.abs(F.col("value") - F.col("reference"))
    limit = F.lit(relative_tolerance) * F.greatest(F.lit(1.0), F.abs(F.col("reference")))
    return a.join(b, "name", "full_outer").withColumn(
        "status",
        F.when(F.col("value").isNull(), "missing")
        .when(F.col("reference").isNull(), "new")
        .when(gap > limit, "FAIL")
        .otherwise("PASS"),
    )


def required_values(
    df: DataFrame, column: str, required: list[str], optional_prefix: str | None = None
) -> DataFrame:
    """Row counts of listed values, those by prefix if present, and a row per missing one."""
    wanted = F.col(column).isin(required)
    if optional_prefix is not None:
        wanted = wanted | F.col(column).startswith(optional_prefix)
    found = df.where(wanted).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    asked = df.sparkSession.createDataFrame([(v,) for v in required], f"{column} string")
    gone = asked.join(found, column, "left_anti").select(column, F.lit(0).cast("bigint").alias("n"))
    return found.withColumn("missing", F.lit(False)).unionByName(gone.withColumn("missing", F.lit(True)))


def checksum_audit(files: DataFrame, expected: DataFrame) -> DataFrame:
    """SHA-256 of binary files against expected (name, sha256)."""
    actual = files.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("name"),
        F.sha2("content", 256).alias("actual"),
    )
    return expected.join(actual, "name", "full_outer").withColumn(
        "ok", F.coalesce(F.col("actual") == F.col("sha256"), F.lit(False))
    )
