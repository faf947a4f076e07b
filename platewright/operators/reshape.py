"""Long/wide reshaping, set relations, multiplicity correction and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewright.operators.stability import attach


def widen(
    df: DataFrame, index: list[str], columns: str, values: list[str], value: str
) -> DataFrame:
    """One column per listed value. The value list is given, so no job is needed to find it."""
    return df.groupBy(*index).agg(
        *[F.max(F.when(F.col(columns) == v, F.col(value))).alias(str(v)) for v in values]
    )


def columns_by_prefix(df: DataFrame, prefixes: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def lengthen(df: DataFrame, index: list[str], prefixes: tuple[str, ...]) -> DataFrame:
    """Replicate columns found by prefix as (measure, value) rows, missing values dropped."""
    cols = columns_by_prefix(df, prefixes)
    wide = df.select(*index, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(index, cols, "measure", "value").where(F.col("value").isNotNull())


def stack_tables(tables: dict[str, DataFrame], label: str = "source_table") -> DataFrame:
    """Union by column name of tables with different columns, with a source label."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def set_overlap(members: DataFrame, set_col: str, id_col: str) -> DataFrame:
    """Intersection, union and Jaccard of every two sets of a membership table.

    The join key is the member id and a member belongs to at most as many rows as there are sets,
    so no set is ever gathered.
    """
    m = members.select(set_col, id_col).distinct()
    sizes = m.groupBy(set_col).agg(F.count(F.lit(1)).alias("_n"))
    a = m.select(F.col(set_col).alias("set_a"), id_col)
    b = m.select(F.col(set_col).alias("set_b"), id_col)
    hits = a.join(b, id_col).groupBy("set_a", "set_b").agg(F.count(F.lit(1)).alias("intersection"))
    sa = sizes.select(F.col(set_col).alias("set_a"), F.col("_n").alias("size_a"))
    sb = sizes.select(F.col(set_col).alias("set_b"), F.col("_n").alias("size_b"))
    union = F.col("size_a") + F.col("size_b") - F.col("intersection")
    return (
        hits.join(sa, "set_a")
        .join(sb, "set_b")
        .withColumn("union_size", union)
        .withColumn("jaccard", F.col("intersection") / union)
    )


def holm(df: DataFrame, families: list[str], p: str, tie: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values; a family is a list of model comparisons."""
    w = W.partitionBy(*families)
    ordered = w.orderBy(F.col(p), F.col(tie))
    factor = F.count(F.lit(1)).over(w) - F.row_number().over(ordered) + 1
    step = df.withColumn("_step", factor * F.col(p))
    running = F.max("_step").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    return step.withColumn(out, F.least(F.lit(1.0), running)).drop("_step")


def upsert(previous: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows replace all previous rows of their keys; other rows stay."""
    kept = previous.join(fresh.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def at_least_fraction_of_best(
    df: DataFrame, groups: list[str], value: str, fraction: float
) -> DataFrame:
    """Inclusive floor relative to the best value of each group."""
    if not groups:
        best = df.agg(F.max(value)).scalar()
        return df.withColumn("floor", F.lit(fraction) * best).where(F.col(value) >= F.col("floor"))
    best = df.groupBy(*groups).agg((F.lit(fraction) * F.max(value)).alias("floor"))
    return attach(df, best, groups).where(F.col(value) >= F.col("floor"))


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded); a NULL condition counts as excluded."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(ok), df.where(~ok)


def ordered_subset(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of the requested keys with their place in the request."""
    place = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(key))
    return df.where(F.col(key).isin(wanted)).withColumn("ordinal", (place - 1).cast("bigint"))


def one_sided_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present in exactly one of two tables."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = left.join(right, keys, "full_outer")
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only")
    return both.withColumn("side", side).where(F.col("side").isNotNull()).drop("_a", "_b")


def best_by(df: DataFrame, groups: list[str], criteria: list[str], setting: str) -> DataFrame:
    """The row of the best setting per group: smallest criteria, then smallest setting id."""
    fields = [c for c in df.columns if c not in groups]
    order = F.struct(*[F.col(c) for c in [*criteria, setting]])
    best = df.groupBy(*groups).agg(
        F.min_by(F.struct(*[F.col(c) for c in fields]), order).alias("_best")
    )
    return best.select(*groups, "_best.*")
