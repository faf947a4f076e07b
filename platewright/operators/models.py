"""Baseline models over folds: neighbours as joins, linear models from second moments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.functions.vectors import dot, scaled_distance
from platewright.operators import reshape
from platewright.operators.stability import attach, spread_out, stable


def _field(name: str) -> Callable[[Column], Column]:
    return lambda r: r[name]


def split_scales(
    df: DataFrame, groups: list[str], fold: str, k: int, vec: str, nested: bool
) -> DataFrame:
    """Population SD of every dimension over the train rows of each split, as one map per group.

    Train moments are group totals minus the left-out folds, so rows are aggregated once per fold and
    not once per split. Constant dimensions scale to 1. Map keys are ``outer * k + inner``.
    """
    per_fold = (
        df.select(*groups, fold, F.posexplode(vec).alias("_dim", "_x"))
        .groupBy(*groups, fold, "_dim")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_x").alias("_s"),
            F.sum(F.col("_x") * F.col("_x")).alias("_q"),
        )
    )
    ids = [(o, i) for o in range(k) for i in range(k) if nested or o == i]
    aggs = []
    for o, i in ids:
        kept = ~F.col(fold).isin(o, i)
        n, s, q = (F.sum(F.when(kept, F.col(c))) for c in ("_n", "_s", "_q"))
        var = q / n - (s / n) * (s / n)
        usable = (n > 0) & (var > F.lit(1e-12) * q / n)
        aggs.append(F.when(usable, F.sqrt(var)).otherwise(1.0).alias(f"_sd{o * k + i}"))
    dims = per_fold.groupBy(*groups, "_dim").agg(*aggs)
    names = [f"_sd{o * k + i}" for o, i in ids]
    rows = F.array_sort(F.collect_list(F.struct("_dim", *names)))
    entries = []
    for (o, i), name in zip(ids, names):
        entries += [F.lit(o * k + i), F.transform("_rows", _field(name))]
    by_group = dims.groupBy(*groups).agg(rows.alias("_rows"))
    return by_group.select(*groups, F.create_map(*entries).alias("_sds"))


def neighbour_predictions(
    df: DataFrame,
    groups: list[str],
    fold: str,
    key: str,
    y: str,
    ks: list[int],
    k: int,
    nested: bool,
    vec: str = "vec",
) -> DataFrame:
    """Inverse-distance kNN of the test rows of each (outer, inner) split, for every k that fits.

    Pairs exist only inside a bounded group and are formed once; splits are cut from the pair table,
    which stays partitioned by group up to the predictions. An exact match (distance 0) wins outright.
    """
    df = spread_out(df.select(*groups, fold, key, vec, y), *groups)
    train = df.select(
        *groups, F.col(fold).alias("_fb"), F.col(vec).alias("_vb"), F.col(y).alias("_y"), F.col(key).alias("_id")
    )
    test = df.select(*groups, F.col(fold).alias("inner"), key, F.col(vec).alias("_va"), F.col(y).alias("observed"))
    outers = F.sequence(F.lit(0), F.lit(k - 1)) if nested else F.array("inner")
    pairs = (
        test.join(train, groups)
        .where(F.col("inner") != F.col("_fb"))
        .join(split_scales(df, groups, fold, k, vec, nested), groups)
        .withColumn("outer", F.explode(outers))
        .where(F.col("outer") != F.col("_fb"))
    )
    sd = F.element_at("_sds", F.col("outer") * k + F.col("inner"))
    scored = pairs.withColumn("_d", scaled_distance("_va", "_vb", sd)).drop("_va", "_vb", "_sds", "_fb")
    unit = [*groups, "outer", "inner", key]
    w = W.partitionBy(*unit)
    near = (
        scored.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_r", F.row_number().over(w.orderBy("_d", "_id")))
        .where(F.col("_r") <= max(ks))
        .withColumn("k", F.explode(F.array(*[F.lit(v) for v in ks])))
        .where((F.col("_r") <= F.col("k")) & (F.col("k") <= F.col("_n")))
    )
    exact = F.col("_d") == 0
    inverse = F.when(~exact, F.lit(1.0) / F.col("_d"))
    return (
        near.groupBy(*unit, "observed", "k")
        .agg(
            F.avg(F.when(exact, F.col("_y"))).alias("_exact"),
            F.try_divide(F.sum(inverse * F.col("_y")), F.sum(inverse)).alias("_weighted"),
        )
        .select(*unit, "observed", "k", F.coalesce("_exact", "_weighted").alias("predicted"))
    )


def nested_choice(
    predictions: DataFrame, groups: list[str], key: str, setting: str
) -> DataFrame:
    """Pick the setting with the smallest inner MAE per outer fold and keep its outer predictions."""
    inner = predictions.where(F.col("inner") != F.col("outer"))
    mae = inner.groupBy(*groups, "outer", setting).agg(
        F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("inner_mae")
    )
    best = reshape.best_by(mae, [*groups, "outer"], ["inner_mae"], setting)
    outer = predictions.where(F.col("inner") == F.col("outer"))
    return outer.join(best, [*groups, "outer", setting]).drop("inner")


def _solver(moments: DataFrame, groups: list[str], solve: Callable, extra: list[T.StructField]) -> DataFrame:
    """Apply a small dense solve to each (d + 1)^2 moment matrix; the last variable is the target."""
    fields = [moments.schema[g] for g in groups]
    schema = T.StructType(
        [
            *fields,
            *extra,
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coef", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = np.asarray(row["moments"]).reshape(int(row["width"]), -1)
                n, means = m[0, 0], m[0, 1:] / m[0, 0]
                centred = m[1:, 1:] - n * np.outer(means, means)
                sd = np.sqrt(np.maximum(np.diag(centred)[:-1], 0.0) / n)
                sd = np.where(sd > 0, sd, 1.0)
                xx = centred[:-1, :-1] / np.outer(sd, sd)
                xy, yy = centred[:-1, -1] / sd, centred[-1, -1]
                for head, w in solve(xx, xy, yy, n):
                    coef = w / sd
                    intercept = float(means[-1] - coef @ means[:-1])
                    out.append((*[row[g] for g in groups], *head, intercept, coef.tolist()))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return moments.select(*groups, "moments", "width").mapInPandas(run, schema)


def ridge(moments: DataFrame, groups: list[str], alphas: list[float]) -> DataFrame:
    """Ridge on scaled features with a free intercept, for every alpha."""

    def solve(xx, xy, yy, n):
        for a in alphas:
            yield (float(a),), np.linalg.solve(xx + a * np.eye(len(xx)), xy)

    return _solver(moments, groups, solve, [T.StructField("alpha", T.DoubleType())])


def bayesian_ridge(
    moments: DataFrame, groups: list[str], rounds: int = 300, tolerance: float = 1e-3
) -> DataFrame:
    """Evidence maximisation by fixed-point updates on the moment matrix (gamma priors 1e-6)."""
    prior = 1e-6

    def solve(xx, xy, yy, n):
        values, axes = np.linalg.eigh(xx)
        values = np.maximum(values, 0.0)
        rotated = axes.T @ xy
        noise, weight = 1.0 / (yy / n + np.finfo(float).eps), 1.0
        w = np.zeros(len(xy))
        for _ in range(rounds):
            previous = w
            w = axes @ (rotated / (values + weight / noise))
            error = max(float(yy - 2 * w @ xy + w @ xx @ w), 0.0)
            used = float(np.sum(noise * values / (weight + noise * values)))
            weight = (used + 2 * prior) / (float(w @ w) + 2 * prior)
            noise = (n - used + 2 * prior) / (error + 2 * prior)
            if np.abs(w - previous).sum() < tolerance:
                break
        w = axes @ (rotated / (values + weight / noise))
        yield (noise, weight), w

    return _solver(
        moments,
        groups,
        solve,
        [T.StructField("noise_precision", T.DoubleType()), T.StructField("weight_precision", T.DoubleType())],
    )


def linear_predictions(df: DataFrame, models: DataFrame, groups: list[str], vec: str) -> DataFrame:
    """Join the few coefficient rows back and take a dot product."""
    return (
        attach(df, models, groups)
        .withColumn("predicted", F.col("intercept") + dot(vec, "coef"))
        .drop("coef", "intercept")
    )


def nested_ridge(
    df: DataFrame, fold: str, k: int, vec: str, y: str, alphas: list[float]
) -> tuple[DataFrame, DataFrame]:
    """Ridge whose penalty is chosen inside each outer fold: (predictions, criteria per outer fold and alpha).

    The moments of every fold come from one pass. The train side of an inner split (outer o, inner i) is the sum
    over the other folds, so held-out rows never enter the choice. The k * k * alphas small models reach the rows
    as one map value: rows are not shuffled.
    """
    from platewright.operators.features import second_moments
    from platewright.operators.reshape import best_by

    joint = df.select(fold, F.concat(F.col(vec), F.array(F.col(y).cast("double"))).alias("_xy"))
    every = F.sequence(F.lit(0), F.lit(k - 1))
    cells = second_moments(joint, [fold], "_xy").select(fold, "width", F.posexplode("moments").alias("_cell", "_x"))
    cells = cells.withColumn("outer", F.explode(every)).withColumn("inner", F.explode(every))
    train = (
        cells.where((F.col(fold) != F.col("outer")) & (F.col(fold) != F.col("inner")))
        .groupBy("outer", "inner", "width", "_cell")
        .agg(F.sum("_x").alias("_x"))
        .groupBy("outer", "inner", "width")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "_x"))), lambda c: c["_x"]).alias("moments"))
    )
    models = stable(ridge(train, ["outer", "inner"], alphas))

    def by_fold(chosen: DataFrame, at: str) -> Column:
        lists = chosen.groupBy(at).agg(F.collect_list(F.struct("outer", "alpha", "intercept", "coef")).alias("m"))
        return lists.agg(F.map_from_entries(F.collect_list(F.struct(at, "m")))).scalar()

    def predict(chosen: DataFrame, at: str) -> DataFrame:
        table = by_fold(chosen, at)
        rows = df.select("*", F.explode(F.try_element_at(table, F.col(fold))).alias("_m"))
        return rows.withColumn("predicted", F.col("_m.intercept") + dot(vec, "_m.coef"))

    inner = predict(models.where("outer <> inner"), "inner").select(
        F.col("_m.outer").alias("outer"), F.col("_m.alpha").alias("alpha"), F.abs(F.col(y) - F.col("predicted")).alias("_e")
    )
    criteria = stable(inner.groupBy("outer", "alpha").agg(F.avg("_e").alias("inner_mae")))
    best = best_by(criteria, ["outer"], ["inner_mae"], "alpha").select("outer", "alpha")
    outer = predict(models.where("outer = inner").join(best, ["outer", "alpha"]), "outer")
    return outer.withColumn("alpha", F.col("_m.alpha")).drop("_m"), criteria


Scorer = Callable[[pd.DataFrame, pd.DataFrame, dict], "np.ndarray"]


def fixed_outer_cv(
    df: DataFrame, groups: list[str], fold: str, key: str, y: str, scorer: Scorer, params: dict, k: int
) -> DataFrame:
    """Outer cross-validation of any ``scorer(train, test, params) -> predictions``.

    Work units are (group, fold) pairs of bounded groups.
    """
    from platewright.operators.folds import fold_roles

    units = [*groups, "outer_fold"]
    roles = fold_roles(df, fold, k)
    schema = T.StructType(
        [
            *[roles.schema[c] for c in units],
            roles.schema[key],
            T.StructField("observed", T.DoubleType()),
            T.StructField("predicted", T.DoubleType()),
        ]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        if train.empty or test.empty:
            return pd.DataFrame(columns=[f.name for f in schema])
        predicted = np.asarray(scorer(train, test, params), float)
        return test.assign(observed=test[y].astype(float), predicted=predicted)[
            [f.name for f in schema]
        ]

    return spread_out(roles, *units).groupBy(*units).applyInPandas(run, schema)


def assemble_comparators(tables: DataFrame, key: str, reference: str, is_score: Column) -> dict:
    """Coverage, metric table, best model by MAE and gain over a reference of a stacked long table."""
    from platewright.operators import checks, metrics

    m = stable(metrics.score_only(metrics.metric_table(tables, ["model"]), is_score))
    best = m.where(F.col("mae").isNotNull()).agg(F.min_by("model", F.struct("mae", "model"))).scalar()
    errors = tables.withColumn("abs_error", metrics.abs_error())
    wide = errors.groupBy(key).agg(
        F.max(F.when(F.col("model") == reference, F.col("abs_error"))).alias("reference_error"),
        F.max(F.when(F.col("model") == best, F.col("abs_error"))).alias("best_error"),
    )
    gains = wide.withColumn("gain", F.col("reference_error") - F.col("best_error"))
    return {
        "coverage": checks.model_coverage(tables, "model", key),
        "metrics": m.withColumn("is_best", F.col("model") == best),
        "gains": gains,
    }
