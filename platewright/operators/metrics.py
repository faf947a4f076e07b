"""Error, rank-correlation, coverage and calibration metrics over long prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions.common import col, correlation, is_bad_double, literal_rows
from platewright.functions.normal import Z95, Z_LEVELS, gaussian_nlpd
from platewright.operators.ranking import average_ranks, group_quantiles, quantiles_of
from platewright.operators.stability import attach, written


def abs_error(observed: str = "observed", predicted: str = "predicted") -> Column:
    return F.abs(F.col(observed) - F.col(predicted))


def relative_error(observed: str = "observed", predicted: str = "predicted") -> Column:
    """Absolute error over the observed value; NULL unless the denominator is positive."""
    return F.when(F.col(observed) > 0, abs_error(observed, predicted) / F.col(observed))


def standardised_residual(sd: str | Column = "sd") -> Column:
    return F.try_divide(F.col("observed") - F.col("predicted"), col(sd))


def interval(sd: str | Column = "sd", z: float = Z95) -> dict[str, Column]:
    half = F.lit(z) * col(sd)
    return {
        "lower": F.col("predicted") - half,
        "upper": F.col("predicted") + half,
        "width": F.lit(2.0) * half,
    }


def rank_correlation(
    df: DataFrame, groups: list[str], x: str = "observed", y: str = "predicted", out: str = "spearman"
) -> DataFrame:
    """Spearman rho on tie-averaged ranks; NULL where a side is constant."""
    rows = df.select(*groups, x, y).na.drop(subset=[x, y])
    ranked = average_ranks(rows, groups, {x: "_rx", y: "_ry"})
    return ranked.groupBy(*groups).agg(correlation("_rx", "_ry").alias(out))


def regression_metrics(df: DataFrame, groups: list[str], sd: str | None = None) -> DataFrame:
    """MAE, RMSE, R2, Pearson (and NLPD) in one partially aggregated pass."""
    err = F.col("observed") - F.col("predicted")
    n = F.count(F.lit(1))
    total = F.var_pop("observed") * n
    aggs = [
        n.alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(total > 0, F.lit(1.0) - F.sum(err * err) / total).alias("r2"),
        F.when(n > 2, correlation("observed", "predicted")).alias("pearson"),
    ]
    if sd:
        aggs.append(F.avg(gaussian_nlpd("observed", "predicted", sd)).alias("nlpd"))
    return df.groupBy(*groups).agg(*aggs)


def metric_table(df: DataFrame, groups: list[str], sd: str | None = None) -> DataFrame:
    """Regression metrics together with Spearman rho."""
    return regression_metrics(df, groups, sd).join(rank_correlation(df, groups), groups, "left")


def score_only(metrics: DataFrame, is_score: Column) -> DataFrame:
    """Null the unit-bound metrics of models that only emit a score."""
    out = metrics
    for c in ("mae", "rmse", "r2"):
        out = out.withColumn(c, F.when(~is_score, F.col(c)))
    return out


def error_by_group(df: DataFrame, groups: list[str]) -> DataFrame:
    """Count, mean and median error, mean observed and median relative error per group."""
    rows = df.withColumn("_e", abs_error()).withColumn("_re", relative_error())
    flat = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_e").alias("mean_error"),
        F.avg("observed").alias("mean_observed"),
    )
    med = quantiles_of(rows, groups, {"_e": {"median_error": 0.5}, "_re": {"median_relative": 0.5}})
    return flat.join(med, groups)


def holdout_summary(df: DataFrame, groups: list[str], sd: str = "sd") -> DataFrame:
    rows = df.withColumn("_e", abs_error())
    flat = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_e").alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg(sd).alias("mean_sd"),
    )
    return flat.join(group_quantiles(rows, groups, "_e", {"median_error": 0.5}), groups)


def coverage(
    df: DataFrame,
    groups: list[str],
    sds: dict[str, str | Column],
    levels: dict[str, tuple[float, float]] = Z_LEVELS,
) -> DataFrame:
    """Share of observations inside each central interval.

    Every (level, SD) pair is one conditional average of a single pass; rows are not multiplied.
    """
    names = list(levels)
    aggs = []
    for i, name in enumerate(names):
        z = levels[name][1]
        for label, sd in sds.items():
            aggs.append(
                F.avg((abs_error() <= F.lit(z) * col(sd)).cast("double")).alias(f"_{label}_{i}")
            )
    wide = df.groupBy(*groups).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("interval"),
                F.lit(levels[name][0]).alias("nominal"),
                F.lit(levels[name][1]).alias("z"),
                *[F.col(f"_{label}_{i}").alias(label) for label in sds],
            )
            for i, name in enumerate(names)
        ]
    )
    return wide.select(*groups, F.explode(rows).alias("_r")).select(*groups, "_r.*")


def sigma_scale(df: DataFrame, groups: list[str], sd: str = "sd", out: str = "scale") -> DataFrame:
    """RMS standardised residual over rows with finite values and a positive SD."""
    ok = ~is_bad_double(F.col("observed")) & ~is_bad_double(F.col("predicted"))
    ok = ok & ~is_bad_double(F.col(sd)) & (F.col(sd) > 0)
    r = standardised_residual(sd)
    return df.where(ok).groupBy(*groups).agg(F.sqrt(F.avg(r * r)).alias(out))


def apply_scale(
    df: DataFrame, scales: DataFrame, groups: list[str], sd: str = "sd", out: str = "sd_calibrated"
) -> DataFrame:
    """Multiply each predicted SD by the calibration scale of its group (1 when none)."""
    return (
        attach(df, scales, groups, "left")
        .withColumn(out, F.col(sd) * F.coalesce(F.col("scale"), F.lit(1.0)))
        .drop("scale")
    )


def spread(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Minimum, median and maximum of many columns, as long rows."""
    long = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        groups, columns, "name", "value"
    )
    keys = [*groups, "name"]
    flat = long.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return flat.join(group_quantiles(long, keys, "value", {"median": 0.5}), keys)


def box_statistics(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Quartiles and the most extreme values within 1.5 IQR of the box."""
    q = group_quantiles(df, groups, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (
        attach(df, q, groups)
        .groupBy(*groups, "q1", "q2", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def shared_histogram(
    df: DataFrame, groups: list[str], value: str, bins: int = 11, margin: float = 0.2
) -> DataFrame:
    """Counts on equal-width bins over the joint value range widened by ``margin``."""
    ends = df.agg(
        F.struct(
            (F.min(value) - F.lit(margin)).alias("lo"), (F.max(value) + F.lit(margin)).alias("hi")
        ).alias("e")
    ).scalar()
    width = (ends["hi"] - ends["lo"]) / F.lit(float(bins))
    at = F.floor((F.col(value) - ends["lo"]) / width)
    return (
        df.select(*groups, F.least(at, F.lit(bins - 1)).cast("bigint").alias("bin"))
        .groupBy(*groups, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def long_values(
    df: DataFrame, keys: list[str], columns: list[str], section: str | None = None
) -> DataFrame:
    """Metric table to (name, num, txt) rows named ``section.keys.column``."""
    types = dict(df.dtypes)
    parts = [F.lit(section)] if section else []
    records = []
    for c in columns:
        text = types[c] == "string"
        records.append(
            F.struct(
                F.concat_ws(".", *parts, *[F.col(k).cast("string") for k in keys], F.lit(c)).alias("name"),
                (F.lit(None) if text else F.col(c)).cast("double").alias("num"),
                (F.col(c) if text else F.lit(None)).cast("string").alias("txt"),
            )
        )
    return df.select(F.explode(F.array(*records)).alias("_r")).select("_r.*")


def exploded_levels(values: list[dict], schema: str) -> Column:
    """A fixed parameter list as generated rows (explode of a literal, not a join)."""
    return F.explode(literal_rows(values, schema))


def robust_z(
    df: DataFrame, groups: list[str], value: str, out: str, higher_is_better: bool = True
) -> DataFrame:
    """0.6745 (x - median)/MAD; population SD when the MAD is 0; missing values score 0."""
    x = F.col(value).cast("double")
    rows = df.withColumn("_x", x)
    if not groups:
        rows = rows.withColumn("_all", F.lit(0))
    keys = groups or ["_all"]
    med = group_quantiles(rows, keys, "_x", {"_med": 0.5})
    with_med = attach(rows, med, keys, "left")
    dev = with_med.withColumn("_dev", F.abs(F.col("_x") - F.col("_med")))
    mad = group_quantiles(dev, keys, "_dev", {"_mad": 0.5})
    sd = rows.groupBy(*keys).agg(F.stddev_pop("_x").alias("_sd"))
    diff = F.col("_x") - F.col("_med")
    z = F.when(F.col("_mad") > 0, F.lit(0.6745) * diff / F.col("_mad")).when(
        F.col("_sd") > 0, diff / F.col("_sd")
    )
    sign = F.lit(1.0 if higher_is_better else -1.0)
    return (
        attach(with_med, sd.join(mad, keys, "left"), keys, "left")
        .withColumn(out, sign * F.coalesce(z, F.lit(0.0)))
        .drop("_x", "_med", "_mad", "_sd", "_all")
    )


def composite_score(
    df: DataFrame, key: str, structural: dict[str, bool], other: dict[str, bool]
) -> DataFrame:
    """0.7 x mean of the structural robust z-scores + 0.3 x the other one, per key.

    All metrics are standardised together in long form, so the medians cost one sort, not one each.
    """
    up = {**structural, **other}
    names = list(up)
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [key], names, "metric", "value"
    )
    z = robust_z(long, ["metric"], "value", "z")
    signed = F.when(F.col("metric").isin([c for c in names if up[c]]), F.col("z")).otherwise(-F.col("z"))
    in_structural = F.col("metric").isin(list(structural))
    return (
        z.groupBy(key)
        .agg(
            F.avg(F.when(in_structural, signed)).alias("structural"),
            F.avg(F.when(~in_structural, signed)).alias("other"),
        )
        .withColumn("score", F.lit(0.7) * F.col("structural") + F.lit(0.3) * F.col("other"))
    )


def pairwise_delta_correlation(df: DataFrame, key: str, set_col: str, delta: str) -> DataFrame:
    """Correlation of per-key deltas between every two sets (sets per key are few).

    The deltas are written once: what made them does not run once per side in the tasks that pair them.
    """
    rows = written(df.select(key, set_col, delta), "deltas")
    a = rows.select(key, F.col(set_col).alias("set_a"), F.col(delta).alias("_da"))
    b = rows.select(key, F.col(set_col).alias("set_b"), F.col(delta).alias("_db"))
    return (
        a.join(b, key)
        .where(F.col("set_a") < F.col("set_b"))
        .groupBy("set_a", "set_b")
        .agg(correlation("_da", "_db").alias("correlation"), F.count(F.lit(1)).alias("n"))
    )
