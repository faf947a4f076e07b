"""Replicate, plate and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions.variants import well_label
from platewright.operators import assay as A
from platewright.operators import folds, metrics as M, relate, reshape as S
from platewright.plans import views as V
from platewright.plans.metric_queries import metrics_sql, rho_sql
from platewright.plans.registry import query

SLOPE, HOURS, MASS, CAL_MAX = 0.5, 2.0, 4.0, 400.0


def plates(spark, sf):
    """(converted wells, plate metadata)."""
    w = V.wells(spark, sf).withColumn("doubled", F.col("k") % 9 == 0)
    meta = A.plate_metadata(w, SLOPE, HOURS, MASS, CAL_MAX)
    return A.convert_wells(w, meta, SLOPE, HOURS, MASS, "doubled"), meta


_META = f"""SELECT plate, avg(raw_od) AS blank_od, stddev_samp(raw_od) / sqrt(count(raw_od)) AS blank_sem,
3 * stddev_samp(raw_od) / sqrt(count(raw_od)) / {SLOPE * HOURS * MASS} AS lod, {CAL_MAX / HOURS / MASS}::DOUBLE AS calibrated_max
FROM v_well WHERE is_blank GROUP BY 1"""
_CONV = f"""SELECT *, at_or_below_blank = FALSE AND variant IS NOT NULL AS used FROM (SELECT w.*, raw_od - blank_od AS corrected_od,
(raw_od - blank_od) / {SLOPE} AS conc, (raw_od - blank_od) / {SLOPE} / {HOURS} / ({MASS} * CASE WHEN k % 9 = 0 THEN 2.0::DOUBLE ELSE 1.0 END) AS spec_act,
CASE WHEN k % 9 = 0 THEN 200 ELSE 100 END AS loading, raw_od - blank_od <= 0 AS at_or_below_blank
FROM v_well w LEFT JOIN meta USING (plate) WHERE NOT is_blank)"""
_ACT = """SELECT plate, variant, count(*) AS n, avg(spec_act) AS spec_act, stddev_samp(spec_act) / sqrt(count(*)) AS spec_act_sem,
avg(conc) / 1000.0 AS product, array_to_string(list_sort(list_distinct(list(loading))), ', ') AS loadings FROM conv WHERE used GROUP BY 1, 2"""
_PLATE = f"WITH meta AS ({_META}), conv AS ({_CONV}), act AS ({_ACT}) "


@query(
    "arr_1",
    """SELECT variant_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(value)) AS sem
    FROM v_rep GROUP BY 1""",
    "mean sd sem",
)
def arr_1(spark, sf):
    return A.replicate_statistics(V.replicate_values(spark, sf), ["variant_id"], "value")


_SEMS = """SELECT variant_id, (('0x' || substr(md5(variant_id::VARCHAR), 1, 8))::BIGINT % 5)::INT AS fold,
stddev_samp(value) / sqrt(count(value)) AS sem FROM v_rep GROUP BY 1"""


@query(
    "mth_5",
    f"""WITH s AS ({_SEMS}), f AS (SELECT fold, median(sem) AS fill FROM s WHERE sem > 0 GROUP BY 1)
    SELECT variant_id, fold, coalesce(sem, fill, 0) AS sem_used FROM s LEFT JOIN f USING (fold)""",
    "sem_used",
    "fold",
)
def mth_5(spark, sf):
    """The training scope is the fold."""
    r = A.replicate_statistics(V.replicate_values(spark, sf), ["variant_id"], "value")
    r = folds.assign_folds(r, "variant_id", 5)
    return A.impute_training_sem(r, ["fold"], "sem", "sem_used").select("variant_id", "fold", "sem_used")


@query(
    "mth_6",
    """WITH t AS (SELECT model, mutation_order, count(*) AS n, sum(observed) AS s, sum(observed * observed) AS q FROM v_pred GROUP BY 1, 2),
    c AS (SELECT model, mutation_order, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s, sum(q) OVER w - q AS q FROM t WINDOW w AS (PARTITION BY model))
    SELECT model, mutation_order, s / n AS mean, sqrt((q - s * s / n) / (n - 1)) AS sd_sample,
    CASE WHEN q / n - (s / n) ** 2 > 0 THEN sqrt(q / n - (s / n) ** 2) ELSE 1 END AS sd_population FROM c""",
    "mean sd_sample sd_population",
    "mutation_order",
    digits=5,
)
def mth_6(spark, sf):
    """Target scale of everything outside each (model, order) fold, both conventions."""
    m = folds.complement_moments(V.predictions(spark, sf), ["model"], "mutation_order", ["observed"])
    n, s, q = F.col("n_train"), F.col("sum_observed"), F.col("sumsq_observed")
    var = q / n - F.pow(s / n, F.lit(2))
    return m.select(
        "model",
        "mutation_order",
        (s / n).alias("mean"),
        F.sqrt((q - s * s / n) / (n - 1)).alias("sd_sample"),
        F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("sd_population"),
    )


@query(
    "mth_7",
    "SELECT p_partkey, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand, p_size::DOUBLE AS size, -1.0::DOUBLE AS absent FROM part",
    "brand size absent",
)
def mth_7(spark, sf):
    from platewright.functions.numeric import numeric_or_default

    part = V.table(spark, sf, "part").withColumn("brand", F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    return part.select(
        "p_partkey",
        numeric_or_default(part, "brand").alias("brand"),
        numeric_or_default(part, "p_size").alias("size"),
        numeric_or_default(part, "p_nothing", -1.0).alias("absent"),
    )


@query(
    "agg_12",
    _PLATE
    + """SELECT plate, count(*) AS n_wells, count(variant) AS n_assigned, 0::BIGINT AS n_non_numeric,
    count_if(at_or_below_blank)::BIGINT AS n_at_or_below_blank, count_if(used)::BIGINT AS n_used FROM conv GROUP BY 1""",
)
def agg_12(spark, sf):
    return A.plate_balance(plates(spark, sf)[0])


@query("agg_13", _PLATE + "SELECT * FROM meta", "blank_od blank_sem lod calibrated_max")
def agg_13(spark, sf):
    return plates(spark, sf)[1]


@query("agg_14", _PLATE + "SELECT * FROM act", "spec_act spec_act_sem product")
def agg_14(spark, sf):
    return A.variant_activity(plates(spark, sf)[0])


@query(
    "agg_15",
    _PLATE
    + """, j AS (SELECT act.*, r.spec_act AS ra, r.product AS rp, lod, calibrated_max, variant <> 'V1' AS design FROM act
    LEFT JOIN (SELECT plate, spec_act, product FROM act WHERE variant = 'V1') r USING (plate) LEFT JOIN meta USING (plate))
    SELECT plate, count(*) AS n_entries, count_if(design AND spec_act > ra)::BIGINT AS n_above_reference,
    count_if(design AND product > rp)::BIGINT AS n_product_above, count_if(spec_act > calibrated_max)::BIGINT AS n_above_range,
    count_if(spec_act < lod)::BIGINT AS n_below_lod, max_by(variant, (spec_act, variant)) FILTER (design AND spec_act <= calibrated_max) AS best_inside,
    min_by(variant, (spec_act, variant)) FILTER (design) AS lowest_design, max(product) AS max_product FROM j GROUP BY 1""",
    "max_product",
)
def agg_15(spark, sf):
    wells, meta = plates(spark, sf)
    return A.against_references(A.variant_activity(wells), meta, "V1")


@query(
    "agg_16",
    _PLATE
    + """, w AS (SELECT variant, max(CASE WHEN plate = 'view' THEN product END) AS a, max(CASE WHEN plate = 'click' THEN product END) AS b FROM act GROUP BY 1)
    SELECT count(*) AS n_both, count_if(b < a)::BIGINT AS n_decrease, count_if(b >= a)::BIGINT AS n_increase FROM w WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def agg_16(spark, sf):
    return A.direction_counts(A.variant_activity(plates(spark, sf)[0]), "view", "click")


@query(
    "fil_5",
    _PLATE + "SELECT well_id, variant, corrected_od, used FROM conv WHERE variant IS NOT NULL AND NOT used",
    "corrected_od",
)
def fil_5(spark, sf):
    """The excluded wells; the kept ones are counted in AGG-12."""
    wells, _ = plates(spark, sf)
    _, excluded = S.split_by(wells.where(F.col("variant").isNotNull()), F.col("used"))
    return excluded.select("well_id", "variant", "corrected_od", "used")


@query(
    "fil_7",
    _PLATE
    + """SELECT plate, variant, spec_act, spec_act <= calibrated_max AS within_range, spec_act < lod AS below_lod FROM act LEFT JOIN meta USING (plate)""",
    "spec_act",
)
def fil_7(spark, sf):
    wells, meta = plates(spark, sf)
    j = A.variant_activity(wells).join(meta, "plate", "left")
    return j.select(
        "plate",
        "variant",
        "spec_act",
        (F.col("spec_act") <= F.col("calibrated_max")).alias("within_range"),
        (F.col("spec_act") < F.col("lod")).alias("below_lod"),
    )


@query(
    "joi_2",
    "SELECT p_partkey, p_name, i AS ordinal FROM part JOIN (VALUES (7, 0), (3, 1), (150, 2), (42, 3)) AS w(k, i) ON p_partkey = k",
    "",
    "ordinal",
)
def joi_2(spark, sf):
    part = V.table(spark, sf, "part").select("p_partkey", "p_name")
    return S.ordered_subset(part, "p_partkey", [7, 3, 150, 42])


@query(
    "joi_4",
    """WITH a AS (SELECT DISTINCT l_partkey AS k, l_returnflag AS f, l_linestatus AS s, l_linenumber AS n FROM lineitem),
    b AS (SELECT l_partkey AS k, l_returnflag AS f, l_linestatus AS s, l_linenumber AS n, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2, 3, 4)
    SELECT k, f, s, n, q, 'matched' AS status FROM a JOIN b USING (k, f, s, n) UNION ALL
    SELECT k, f, s, n, NULL, 'unmatched' FROM a ANTI JOIN b USING (k, f, s, n)""",
    "q",
    "n",
)
def joi_4(spark, sf):
    line = V.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"),
        F.col("l_returnflag").alias("f"),
        F.col("l_linestatus").alias("s"),
        F.col("l_linenumber").alias("n"),
        "l_quantity",
        "l_discount",
    )
    keys = ["k", "f", "s", "n"]
    b = line.where(F.col("l_discount") > 0.05).groupBy(*keys).agg(F.sum("l_quantity").alias("q"))
    hit, miss = relate.left_with_unmatched(line.select(*keys).distinct(), b, keys)
    return S.stack_tables({"matched": hit, "unmatched": miss}, "status")


@query(
    "joi_5",
    """SELECT l_linenumber::BIGINT AS held_out, (SELECT count(*) FROM lineitem) - count(*) AS n_train,
    (SELECT sum(l_quantity) FROM lineitem) - sum(l_quantity) AS sum_y FROM lineitem GROUP BY 1""",
    "sum_y",
)
def joi_5(spark, sf):
    line = V.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("held_out"), F.col("l_quantity").alias("y")
    )
    return folds.complement_moments(line, [], "held_out", ["y"]).select("held_out", "n_train", "sum_y")


@query(
    "joi_6",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n, sum(p_retailprice) AS total FROM lineitem JOIN
    (SELECT 'P-' || p_partkey AS name, p_retailprice FROM part) ON upper(replace(name, 'P-', '')) = l_partkey::VARCHAR GROUP BY 1, 2""",
    "total",
)
def joi_6(spark, sf):
    from platewright.functions.variants import normalise_key

    named = V.table(spark, sf, "part").select(
        F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("name"), "p_retailprice"
    )
    keyed = named.withColumn("key", normalise_key("name", "^P-"))
    line = V.table(spark, sf, "lineitem").withColumn("key", F.col("l_partkey").cast("string"))
    return (
        line.join(keyed, "key")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("total"))
    )


@query(
    "joi_7",
    _PLATE
    + """, p AS (SELECT plate, well_row, well_col, avg(corrected_od) AS od FROM conv WHERE variant IS NOT NULL GROUP BY 1, 2, 3)
    SELECT a.well_row, a.well_col, a.od AS od_a, b.od AS od_b FROM p a JOIN p b USING (well_row, well_col) WHERE a.plate = 'view' AND b.plate = 'click'""",
    "od_a od_b",
    "well_row well_col",
)
def joi_7(spark, sf):
    return A.matched_positions(plates(spark, sf)[0], "view", "click", ["well_row", "well_col"])


_FOLD = "(('0x' || substr(md5({k}::VARCHAR), 1, 8))::BIGINT % 5)"


@query(
    "joi_8",
    f"""WITH f AS (SELECT n_nationkey, {_FOLD.format(k='n_nationkey')}::INT AS fold FROM nation),
    c AS (SELECT c_custkey, c_acctbal, fold FROM customer JOIN f ON c_nationkey = n_nationkey)
    SELECT o.i AS outer_fold, CASE WHEN fold = o.i THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(c_acctbal) AS total
    FROM c, range(5) AS o(i) GROUP BY 1, 2""",
    "total",
    digits=4,
)
def joi_8(spark, sf):
    nation = folds.assign_folds(V.table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", 5)
    customer = V.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    roles = folds.fold_roles(customer.select("c_custkey", "c_acctbal", "fold"), "fold", 5)
    return roles.groupBy("outer_fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total")
    )


@query(
    "joi_9",
    """SELECT model, ls AS lengthscale, se AS sigma_epi, p AS pca, count(*) AS n FROM v_pred, (VALUES (0.5::DOUBLE), (1), (2)) AS a(ls),
    (VALUES (0.0::DOUBLE), (0.5)) AS b(se), (VALUES (2), (4)) AS c(p) WHERE NOT (model = 'A' AND se > 0) AND NOT (model = 'N' AND p > 2) GROUP BY ALL""",
    "lengthscale sigma_epi",
    "pca",
)
def joi_9(spark, sf):
    """Source x parameter grid with per-source rules, one setting row per model of the table."""
    sources = V.predictions(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    grid = folds.parameter_grid(sources, lengthscale=[0.5, 1.0, 2.0], sigma_epi=[0.0, 0.5], pca=[2, 4])
    additive = (F.col("model") == "A") & (F.col("sigma_epi") > 0)
    reduced = (F.col("model") == "N") & (F.col("pca") > 2)
    return grid.where(~additive & ~reduced).select("model", "lengthscale", "sigma_epi", "pca", "n")


@query(
    "joi_13",
    """WITH a AS (SELECT key FROM v_pred WHERE model = 'A'), r AS (SELECT key FROM v_pred WHERE model = 'R')
    SELECT key, 'left_only' AS side FROM a WHERE key NOT IN (SELECT key FROM r) UNION ALL
    SELECT key, 'right_only' FROM r WHERE key NOT IN (SELECT key FROM a)""",
)
def joi_13(spark, sf):
    p = V.predictions(spark, sf)
    return S.one_sided_keys(p.where(F.col("model") == "A"), p.where(F.col("model") == "R"), ["key"])


@query(
    "joi_14",
    """WITH layout AS (SELECT well_row, well_col, max(variant) AS assigned, bool_or(k % 9 = 0) AS doubled FROM v_well WHERE well_row <> 2 GROUP BY 1, 2)
    SELECT well_id, assigned, coalesce(doubled, FALSE) AS doubled, chr(64 + well_row) || lpad(well_col::VARCHAR, greatest(2, length(well_col::VARCHAR))::INT, '0') AS well
    FROM v_well LEFT JOIN layout USING (well_row, well_col)""",
)
def joi_14(spark, sf):
    w = V.wells(spark, sf)
    layout = (
        w.where(F.col("well_row") != 2)
        .groupBy("well_row", "well_col")
        .agg(F.max("variant").alias("assigned"), F.bool_or(F.col("k") % 9 == 0).alias("doubled"))
    )
    j = w.select("well_id", "well_row", "well_col").join(layout, ["well_row", "well_col"], "left")
    return j.select(
        "well_id",
        "assigned",
        F.coalesce("doubled", F.lit(False)).alias("doubled"),
        well_label("well_row", "well_col").alias("well"),
    )


@query(
    "joi_15",
    f"""WITH a AS ({metrics_sql('v_pred', 'model, mutation_order')}), b AS ({metrics_sql('(SELECT * FROM v_pred WHERE sd < 12)', 'model, mutation_order')})
    SELECT count(*) AS n_compared, 'mae' AS metric, max(abs(a.mae - b.mae)) AS max_difference FROM a JOIN b USING (model, mutation_order) UNION ALL
    SELECT count(*), 'rmse', max(abs(a.rmse - b.rmse)) FROM a JOIN b USING (model, mutation_order)""",
    "max_difference",
)
def joi_15(spark, sf):
    p = V.predictions(spark, sf)
    keys = ["model", "mutation_order"]
    a = M.regression_metrics(p, keys)
    b = M.regression_metrics(p.where(F.col("sd") < 12), keys)
    return relate.compare_metric_tables(a, b, keys, ["mae", "rmse"])


@query(
    "udf_4",
    """SELECT l_returnflag, sqrt(avg((l_quantity - 25) ** 2)) AS rmse, stddev_samp(l_quantity) / sqrt(count(*)) AS sem,
    count_if(NOT l_discount > 0.05)::BIGINT AS n_not_above, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS levels
    FROM lineitem GROUP BY 1""",
    "rmse sem",
)
def udf_4(spark, sf):
    line = V.table(spark, sf, "lineitem")
    return line.groupBy("l_returnflag").agg(
        F.sqrt(F.avg(F.pow(F.col("l_quantity") - 25, F.lit(2)))).alias("rmse"),
        A.sem("l_quantity").alias("sem"),
        F.count_if(~(F.col("l_discount") > 0.05)).alias("n_not_above"),
        F.array_join(F.sort_array(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("levels"),
    )


@query(
    "sta_10",
    f"""WITH j AS (SELECT model, key, observed, predicted, o_orderpriority AS condition, mutation_order FROM v_pred JOIN orders ON key = o_orderkey),
    s AS (SELECT *, 'all' AS scope FROM j UNION ALL SELECT *, 'panel' FROM j WHERE mutation_order > 2), r AS ({rho_sql('s', 'model, condition, scope')})
    SELECT model, condition, scope, n, spearman FROM r JOIN (SELECT model, condition, scope, count(*) AS n FROM s GROUP BY 1, 2, 3) USING (model, condition, scope)""",
    "spearman",
)
def sta_10(spark, sf):
    p = V.predictions(spark, sf).select("model", "key", "predicted", "mutation_order")
    measured = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderpriority").alias("condition"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("observed"),
    )
    scopes = {"all": F.lit(True), "panel": F.col("mutation_order") > 2}
    return A.evaluate_prospectively(p, measured, "key", ["model", "condition"], scopes)


