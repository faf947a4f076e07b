"""Replicate and plate statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.operators.ranking import group_quantiles
from platewright.operators.stats import with_scopes
from platewright.operators.stability import attach


def sem(value: str):
    """Standard error of the mean; NULL for fewer than two values."""
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def replicate_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        sem(value).alias("sem"),
    )


def impute_training_sem(df: DataFrame, fold_cols: list[str], value: str, out: str) -> DataFrame:
    """Missing SEM -> median of the positive finite SEMs of the same training scope (0 if none).

    Existing zeros stay.
    """
    usable = df.where((F.col(value) > 0) & (F.abs(F.col(value)) != F.lit(float("inf"))))
    med = group_quantiles(usable, fold_cols, value, {"_fill": 0.5})
    return (
        attach(df, med, fold_cols, "left")
        .withColumn(out, F.coalesce(F.col(value), F.col("_fill"), F.lit(0.0)))
        .drop("_fill")
    )


def plate_metadata(
    wells: DataFrame, slope: float, hours: float, mass: float, calibrated_max: float
) -> DataFrame:
    """Blank level, detection limit and calibrated maximum of each plate."""
    blanks = wells.where(F.col("is_blank"))
    return (
        blanks.groupBy("plate")
        .agg(F.avg("raw_od").alias("blank_od"), sem("raw_od").alias("blank_sem"))
        .withColumn("lod", F.lit(3.0) * F.col("blank_sem") / F.lit(slope * hours * mass))
        .withColumn("calibrated_max", F.lit(calibrated_max / hours / mass))
    )


def convert_wells(
    wells: DataFrame, meta: DataFrame, slope: float, hours: float, mass: float, doubled: str
) -> DataFrame:
    """Blank-corrected OD, concentration and specific activity of sample wells; doubled wells carry
    twice the enzyme."""
    load = F.when(F.col(doubled), F.lit(2.0)).otherwise(F.lit(1.0))
    sample = wells.where(~F.col("is_blank")).join(meta.select("plate", "blank_od"), "plate", "left")
    return (
        sample.withColumn("corrected_od", F.col("raw_od") - F.col("blank_od"))
        .withColumn("conc", F.col("corrected_od") / F.lit(slope))
        .withColumn("spec_act", F.col("conc") / F.lit(hours) / (F.lit(mass) * load))
        .withColumn("loading", (F.lit(100) * load).cast("int"))
        .withColumn("numeric", F.col("raw_od").isNotNull())
        .withColumn("at_or_below_blank", F.col("numeric") & (F.col("corrected_od") <= 0))
        .withColumn(
            "used", F.col("numeric") & ~F.col("at_or_below_blank") & F.col("variant").isNotNull()
        )
    )


def plate_balance(wells: DataFrame) -> DataFrame:
    return wells.groupBy("plate").agg(
        F.count(F.lit(1)).alias("n_wells"),
        F.count("variant").alias("n_assigned"),
        F.count_if(~F.col("numeric")).alias("n_non_numeric"),
        F.count_if(F.col("at_or_below_blank")).alias("n_at_or_below_blank"),
        F.count_if(F.col("used")).alias("n_used"),
    )


def variant_activity(wells: DataFrame) -> DataFrame:
    """Mean, SEM, product and distinct loadings per plate and variant over used wells."""
    return (
        wells.where(F.col("used"))
        .groupBy("plate", "variant")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("spec_act").alias("spec_act"),
            sem("spec_act").alias("spec_act_sem"),
            (F.avg("conc") / F.lit(1000.0)).alias("product"),
            F.array_join(
                F.sort_array(F.collect_set("loading")).cast("array<string>"), ", "
            ).alias("loadings"),
        )
    )


def against_references(activity: DataFrame, meta: DataFrame, reference: str) -> DataFrame:
    """Counts and extremes of each plate's variants relative to a reference variant."""
    ref = activity.where(F.col("variant") == reference).select(
        "plate", F.col("spec_act").alias("ref_act"), F.col("product").alias("ref_product")
    )
    rows = activity.join(ref, "plate", "left").join(
        meta.select("plate", "lod", "calibrated_max"), "plate", "left"
    )
    design = F.col("variant") != reference
    inside = design & (F.col("spec_act") <= F.col("calibrated_max"))
    return rows.groupBy("plate").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(design & (F.col("spec_act") > F.col("ref_act"))).alias("n_above_reference"),
        F.count_if(design & (F.col("product") > F.col("ref_product"))).alias("n_product_above"),
        F.count_if(F.col("spec_act") > F.col("calibrated_max")).alias("n_above_range"),
        F.count_if(F.col("spec_act") < F.col("lod")).alias("n_below_lod"),
        F.max_by("variant", F.when(inside, F.struct("spec_act", "variant"))).alias("best_inside"),
        F.min_by("variant", F.when(design, F.struct("spec_act", "variant"))).alias("lowest_design"),
        F.max("product").alias("max_product"),
    )


def direction_counts(activity: DataFrame, first: str, second: str) -> DataFrame:
    """How many variants rise or fall between two plates."""
    wide = activity.groupBy("variant").agg(
        F.max(F.when(F.col("plate") == first, F.col("product"))).alias("a"),
        F.max(F.when(F.col("plate") == second, F.col("product"))).alias("b"),
    )
    return wide.na.drop(subset=["a", "b"]).agg(
        F.count(F.lit(1)).alias("n_both"),
        F.count_if(F.col("b") < F.col("a")).alias("n_decrease"),
        F.count_if(F.col("b") >= F.col("a")).alias("n_increase"),
    )


def matched_positions(wells: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """Well positions measured and assigned on both plates, averaged per position before joining."""
    ok = wells.where(F.col("variant").isNotNull() & F.col("numeric"))
    per = ok.groupBy("plate", *keys).agg(F.avg("corrected_od").alias("od"))
    a = per.where(F.col("plate") == first).select(*keys, F.col("od").alias("od_a"))
    b = per.where(F.col("plate") == second).select(*keys, F.col("od").alias("od_b"))
    return a.join(b, keys)


def evaluate_prospectively(
    predicted: DataFrame, measured: DataFrame, key: str, by: list[str], scopes: dict
) -> DataFrame:
    """Rank correlation of predictions and measurements by the given columns (model, condition) and scope."""
    from platewright.operators.metrics import rank_correlation

    joined = with_scopes(predicted.join(measured, key), scopes)
    keys = [*by, "scope"]
    n = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.join(rank_correlation(joined, keys), keys, "left")
