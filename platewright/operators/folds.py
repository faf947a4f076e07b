"""Fold assignment, hold-out relations and fold-complement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions.common import hash32, literal_rows
from platewright.operators.stability import attach


def assign_folds(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    """Deterministic k-fold by hash of the key."""
    return df.withColumn(out, F.pmod(hash32(F.col(key)), F.lit(k)).cast("int"))


def fold_roles(df: DataFrame, fold: str, k: int) -> DataFrame:
    """(outer fold, row, role) relation: each row is test once and train k-1 times. No join."""
    outer = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return df.withColumn("outer_fold", outer).withColumn(
        "role", F.when(F.col("outer_fold") == F.col(fold), "test").otherwise("train")
    )


def complement_moments(
    df: DataFrame, groups: list[str], fold: str, columns: list[str]
) -> DataFrame:
    """Count, sum and sum of squares of all rows outside each fold: totals minus the fold.

    Train statistics of k folds from one aggregation, instead of k passes over the train rows.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        aggs += [F.sum(F.col(c)).alias(f"_s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}")]
    per_fold = df.groupBy(*groups, fold).agg(*aggs)
    names = ["_n"] + [f"_{t}_{c}" for c in columns for t in ("s", "q")]
    totals = df.groupBy(*groups).agg(*[a.alias(f"_all{n}") for a, n in zip(aggs, names)])
    if groups:
        joined = per_fold.join(totals, groups)
        rest = {n: F.col(f"_all{n}") - F.col(n) for n in names}
    else:
        row = totals.select(F.struct(*totals.columns).alias("_t")).scalar()
        joined = per_fold.withColumn("_t", row)
        rest = {n: F.col("_t")[f"_all{n}"] - F.col(n) for n in names}
    out = [rest["_n"].alias("n_train")]
    for c in columns:
        out += [rest[f"_s_{c}"].alias(f"sum_{c}"), rest[f"_q_{c}"].alias(f"sumsq_{c}")]
    return joined.select(*groups, fold, F.col("_n").alias("n_test"), *out)


def train_mean_baseline(df: DataFrame, groups: list[str], fold: str, y: str) -> DataFrame:
    """Every row predicted by the mean of the rows outside its fold."""
    m = complement_moments(df, groups, fold, [y]).select(
        *groups, fold, "n_train", F.try_divide(F.col(f"sum_{y}"), F.col("n_train")).alias("predicted")
    )
    return attach(df, m, [*groups, fold])


def complement_mean_error(df: DataFrame, held_out: str, y: str) -> DataFrame:
    """Error of the complement mean per hold-out group."""
    m = complement_moments(df, [], held_out, [y]).select(
        held_out, "n_test", F.try_divide(F.col(f"sum_{y}"), F.col("n_train")).alias("train_mean")
    )
    return (
        attach(df, m, [held_out])
        .groupBy(held_out, "n_test", "train_mean")
        .agg(F.avg(F.abs(F.col(y) - F.col("train_mean"))).alias("mae"))
    )


def leave_one_out_mean(df: DataFrame, groups: list[str], y: str, out: str) -> DataFrame:
    """(sum - y)/(n - 1) from partially aggregated group totals; NULL for a single row."""
    totals = df.groupBy(*groups).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    value = F.when(F.col("_n") > 1, (F.col("_s") - F.col(y)) / (F.col("_n") - 1))
    return attach(df, totals, groups).withColumn(out, value).drop("_s", "_n")


def parameter_grid(anchor: DataFrame, **axes: list) -> DataFrame:
    """Cartesian product of small literal lists, generated by explode for every row of ``anchor``."""
    out = anchor
    for name, values in axes.items():
        kind = "string" if isinstance(values[0], str) else "double"
        if isinstance(values[0], int) and not isinstance(values[0], bool):
            kind = "int"
        rows = literal_rows([{"v": v} for v in values], f"v: {kind}")
        out = out.withColumn("_x", F.explode(rows)).withColumn(name, F.col("_x.v")).drop("_x")
    return out


def holdout_by_position(
    df: DataFrame, key: str, positions: str, min_train: int = 5
) -> DataFrame:
    """Overlapping attribute hold-outs: test = rows carrying the position, train = all others.

    Returns per-position test and train counts with a usable flag; ``holdout_roles`` gives rows.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    tests = df.select(key, F.explode(F.array_distinct(positions)).alias("position"))
    return (
        tests.groupBy("position")
        .agg(F.count(F.lit(1)).alias("n_test"))
        .withColumn("n_train", total - F.col("n_test"))
        .withColumn("usable", (F.col("n_test") > 0) & (F.col("n_train") >= min_train))
    )


def holdout_roles(df: DataFrame, positions: str, wanted: list[int]) -> DataFrame:
    """Role of every row in each of a fixed list of position hold-outs."""
    return df.withColumn("position", F.explode(F.array(*[F.lit(p) for p in wanted]))).withColumn(
        "role", F.when(F.array_contains(positions, F.col("position")), "test").otherwise("train")
    )


def z_score(value: Column, mean: Column, sd: Column) -> Column:
    """Scaled value; a constant column keeps scale 1."""
    return (value - mean) / F.when(sd > 0, sd).otherwise(F.lit(1.0))
