"""Vector features: scaling, deltas, incremental scoring, second moments and PCA."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from platewright.operators.folds import complement_moments, z_score
from platewright.operators.stability import attach


def standardise_lookup(lookup: DataFrame, columns: list[str]) -> DataFrame:
    """Each column over the whole lookup to mean 0 and population SD 1; targets play no part."""
    stats = lookup.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        )
    ).scalar()
    rows = lookup.withColumn("_s", stats)
    return rows.select(
        *[c for c in lookup.columns if c not in columns],
        *[
            z_score(F.col(c), F.col("_s")[f"m_{c}"], F.col("_s")[f"s_{c}"]).alias(c)
            for c in columns
        ],
    )


def featurise_distinct(
    df: DataFrame, key: list[str], featurise: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run a DataFrame-level feature source on distinct keys only and join the result back."""
    return df.join(featurise(df.select(*key).distinct()), key, "left")


def mean_vector(df: DataFrame, vec: str) -> Column:
    """Element-wise mean as a scalar array; one partially aggregated row per dimension."""
    per_dim = df.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x"))
    return per_dim.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    ).scalar()


def mutation_scores(mutations: DataFrame, key: str, log_probabilities: DataFrame) -> DataFrame:
    """Sum of logp(mut) - logp(wt) over the (key, pos, wt, mut) rows of each variant."""
    p = log_probabilities.select("pos", "residue", "logp")
    mut = p.select("pos", F.col("residue").alias("mut"), F.col("logp").alias("_pm"))
    wt = p.select("pos", F.col("residue").alias("wt"), F.col("logp").alias("_pw"))
    return (
        mutations.join(mut, ["pos", "mut"], "left")
        .join(wt, ["pos", "wt"], "left")
        .groupBy(key)
        .agg(F.sum(F.col("_pm") - F.col("_pw")).alias("score"))
    )


def content_key(*parts: Column) -> Column:
    """Identity of a scored item: scorer name, revision, backend and the whole content."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def score_incrementally(
    df: DataFrame,
    key: str,
    content: str,
    cache_path: str,
    scorer: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Score only contents missing from the cache table, append them, and return all rows scored.

    Copies are scored once. ``scorer`` maps (key, content) rows to (key, score) rows and may be a
    native expression or a ``mapInPandas`` model.
    """
    spark = df.sparkSession

    def cached() -> DataFrame:
        # Overlapping runs may append a key twice: it counts once.
        rows = spark.read.schema(f"{key} string, score double").parquet(cache_path)
        return rows.groupBy(key).agg(F.max("score").alias("score"))

    fresh = df.join(cached().select(key), key, "left_anti").groupBy(key).agg(
        F.any_value(content).alias(content)
    )
    scorer(fresh).select(key, "score").write.mode("append").parquet(cache_path)
    return df.join(cached(), key, "left")


def scale_on_train(df: DataFrame, groups: list[str], fold: str, columns: list[str]) -> DataFrame:
    """Standard scaling with the moments of the rows outside each fold; constants keep scale 1."""
    m = complement_moments(df, groups, fold, columns)
    stats = []
    for c in columns:
        mean = F.try_divide(F.col(f"sum_{c}"), F.col("n_train"))
        var = F.greatest(F.try_divide(F.col(f"sumsq_{c}"), F.col("n_train")) - mean * mean, F.lit(0.0))
        stats += [mean.alias(f"_m_{c}"), F.sqrt(var).alias(f"_s_{c}")]
    joined = attach(df, m.select(*groups, fold, *stats), [*groups, fold])
    for c in columns:
        joined = joined.withColumn(f"{c}_z", z_score(F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return joined.drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def catalogue(store: DataFrame, key: str) -> DataFrame:
    """Distinct keys and vector dimension per source and component."""
    return store.groupBy("source", "component").agg(
        F.countDistinct(key).alias("n_keys"), F.max(F.size("x")).alias("dimension")
    )


def second_moments(df: DataFrame, groups: list[str], vec: str) -> DataFrame:
    """Flattened (1, x)(1, x)' sums per group, as ``moments array<double>`` with ``width`` d + 1.

    Every Arrow batch is reduced to one matrix per group before the shuffle, and matrices are added
    entry by entry, so neither rows nor batches of a hot group meet in one task.
    """
    fields = [df.schema[g] for g in groups]
    schema = T.StructType([*fields, T.StructField("moments", T.ArrayType(T.DoubleType()))])

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(len(groups)).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            x = np.column_stack([np.ones(len(x)), x])
            keys = pd.DataFrame({g: batch.column(i).to_pandas() for i, g in enumerate(groups)})
            parts = keys.groupby(groups, dropna=False, sort=False).indices if groups else {(): slice(None)}
            out = {f.name: [] for f in schema}
            for key, rows in parts.items():
                for g, v in zip(groups, key if isinstance(key, tuple) else (key,)):
                    out[g].append(v)
                out["moments"].append((x[rows].T @ x[rows]).ravel())
            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    arrow_schema = to_arrow_schema(schema)
    partial = df.select(*groups, F.col(vec).alias("_v")).mapInArrow(reduce_batches, schema)
    cells = partial.select(*groups, F.posexplode("moments").alias("_cell", "_x"))
    return (
        cells.groupBy(*groups, "_cell")
        .agg(F.sum("_x").alias("_x"))
        .groupBy(*groups)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_cell", "_x"))), lambda s: s["_x"]
            ).alias("moments")
        )
        .withColumn("width", F.sqrt(F.size("moments").cast("double")).cast("int"))
    )


def complement_second_moments(per_fold: DataFrame, groups: list[str], fold: str) -> DataFrame:
    """Moments of everything outside each fold: totals minus the fold, for matrices."""
    w = W.partitionBy(*groups, "_cell")
    cells = per_fold.select(*groups, fold, "width", F.posexplode("moments").alias("_cell", "_x"))
    rest = cells.withColumn("_x", F.sum("_x").over(w) - F.col("_x"))
    return rest.groupBy(*groups, fold, "width").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_cell", "_x"))), lambda s: s["_x"]).alias(
            "moments"
        )
    )


def principal_axes(moments: DataFrame, groups: list[str], k: int) -> DataFrame:
    """(group, component, mean vector, axis, variance) from moment matrices of size (d+1)^2.

    At most min(k, n - 1, d) components; axis signs are fixed by the largest entry.
    """
    fields = [moments.schema[g] for g in groups]
    schema = T.StructType(
        [
            *fields,
            T.StructField("component", T.IntegerType()),
            T.StructField("centre", T.ArrayType(T.DoubleType())),
            T.StructField("axis", T.ArrayType(T.DoubleType())),
            T.StructField("variance", T.DoubleType()),
        ]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = np.asarray(row["moments"]).reshape(int(row["width"]), -1)
                n, centre = m[0, 0], m[0, 1:] / m[0, 0]
                cov = (m[1:, 1:] - n * np.outer(centre, centre)) / max(n - 1, 1)
                values, axes = np.linalg.eigh(cov)
                take = int(min(k, n - 1, len(centre)))
                for c in range(take):
                    axis = axes[:, -1 - c]
                    axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
                    out.append((*[row[g] for g in groups], c, centre.tolist(), axis.tolist(), float(values[-1 - c])))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return moments.mapInPandas(solve, schema)


def project(df: DataFrame, axes: DataFrame, groups: list[str], vec: str) -> DataFrame:
    """Centred projections of every row on the axes of its group, by join."""
    from platewright.functions.vectors import dot

    centred = F.zip_with(F.col(vec), F.col("centre"), lambda x, m: x - m)
    return attach(df, axes, groups).withColumn("projection", dot(centred, "axis")).drop("centre", "axis")
