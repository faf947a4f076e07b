"""Aggregation and scalar-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions.normal import Z95, Z_LEVELS, quantile_levels
from platewright.operators import metrics as M
from platewright.operators.ranking import group_quantiles, row_positions
from platewright.plans import views as V
from platewright.plans.registry import query

_RHO = """SELECT {g}, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS spearman FROM (
SELECT *, rank() OVER (PARTITION BY {g} ORDER BY observed) + (count(*) OVER (PARTITION BY {g}, observed) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY {g} ORDER BY predicted) + (count(*) OVER (PARTITION BY {g}, predicted) - 1) / 2.0 AS ry
FROM {t}) GROUP BY {g}"""


def rho_sql(table: str = "v_pred", group: str = "model") -> str:
    return _RHO.format(g=group, t=table)


_METRICS = """SELECT {g}, count(*) AS n, avg(abs(observed - predicted)) AS mae,
sqrt(avg((observed - predicted) ** 2)) AS rmse,
1 - sum((observed - predicted) ** 2) / (var_pop(observed) * count(*)) AS r2,
CASE WHEN count(*) > 2 THEN corr(observed, predicted) END AS pearson FROM {t} GROUP BY {g}"""


def metrics_sql(table: str = "v_pred", group: str = "model") -> str:
    return _METRICS.format(g=group, t=table)


@query("agg_1", metrics_sql(), "mae rmse r2 pearson")
def agg_1(spark, sf):
    return M.regression_metrics(V.predictions(spark, sf), ["model"])


@query(
    "agg_2",
    """SELECT model, avg(0.5 * ln(2 * pi() * s * s) + 0.5 * ((observed - predicted) / s) ** 2) AS nlpd
    FROM (SELECT *, greatest(sd, 1e-9) AS s FROM v_pred) GROUP BY model""",
    "nlpd",
)
def agg_2(spark, sf):
    return M.regression_metrics(V.predictions(spark, sf), ["model"], "sd").select("model", "nlpd")


@query("agg_3", rho_sql(), "spearman")
def agg_3(spark, sf):
    return M.rank_correlation(V.predictions(spark, sf), ["model"])


@query(
    "agg_4",
    f"""WITH m AS ({metrics_sql()}), s AS ({rho_sql()}) SELECT model, n, CASE WHEN model <> 'N' THEN mae END AS mae,
    CASE WHEN model <> 'N' THEN rmse END AS rmse, CASE WHEN model <> 'N' THEN r2 END AS r2, pearson, spearman
    FROM m JOIN s USING (model)""",
    "mae rmse r2 pearson spearman",
)
def agg_4(spark, sf):
    return M.score_only(M.metric_table(V.predictions(spark, sf), ["model"]), F.col("model") == "N")


@query(
    "agg_5",
    """SELECT model, mutation_order, count(*) AS n, avg(e) AS mean_error, avg(observed) AS mean_observed,
    median(e) AS median_error, median(CASE WHEN observed > 0 THEN e / observed END) AS median_relative
    FROM (SELECT *, abs(observed - predicted) AS e FROM v_pred) GROUP BY 1, 2""",
    "mean_error mean_observed median_error median_relative",
    "mutation_order",
)
def agg_5(spark, sf):
    return M.error_by_group(V.predictions(spark, sf), ["model", "mutation_order"])


@query(
    "agg_6",
    """SELECT mutation_order, count(*) AS n, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, avg(sd) AS mean_sd,
    median(e) AS median_error FROM (SELECT *, abs(observed - predicted) AS e FROM v_pred) GROUP BY 1""",
    "mae rmse mean_sd median_error",
    "mutation_order",
)
def agg_6(spark, sf):
    return M.holdout_summary(V.predictions(spark, sf), ["mutation_order"])


def _levels_sql(levels) -> str:
    rows = ", ".join(f"('{n}', {p!r}::DOUBLE, {z!r}::DOUBLE)" for n, (p, z) in levels.items())
    return f"(VALUES {rows}) AS l(interval, nominal, z)"


_SCALE_SQL = """SELECT model, sqrt(avg(((observed - predicted) / sd) ** 2)) AS scale
FROM v_pred WHERE sd > 0 GROUP BY model"""


@query(
    "agg_7",
    f"""WITH s AS ({_SCALE_SQL}) SELECT model, interval, nominal, z,
    avg((abs(observed - predicted) <= z * sd)::INT) AS raw,
    avg((abs(observed - predicted) <= z * (sd * scale))::INT) AS calibrated
    FROM v_pred JOIN s USING (model), {_levels_sql(Z_LEVELS)} GROUP BY ALL""",
    "nominal z raw calibrated",
)
def agg_7(spark, sf):
    p = V.predictions(spark, sf)
    scaled = M.apply_scale(p, M.sigma_scale(p, ["model"]), ["model"])
    return M.coverage(scaled, ["model"], {"raw": "sd", "calibrated": "sd_calibrated"})


_RELIABILITY = {f"{p}": (p, z) for p, z in quantile_levels()}


@query(
    "agg_8",
    f"""SELECT model, interval, nominal, z, avg((abs(observed - predicted) <= z * sd)::INT) AS observed_coverage
    FROM v_pred, {_levels_sql(_RELIABILITY)} GROUP BY ALL""",
    "nominal z observed_coverage",
)
def agg_8(spark, sf):
    return M.coverage(
        V.predictions(spark, sf), ["model"], {"observed_coverage": "sd"}, _RELIABILITY
    )


@query(
    "agg_9",
    """SELECT CASE WHEN l_linenumber <> 7 THEN l_linenumber END::BIGINT AS selected_size, l_returnflag AS selected_source,
    l_linestatus AS selected_model, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def agg_9(spark, sf):
    line = V.table(spark, sf, "lineitem")
    return (
        line.groupBy(
            F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("selected_size"),
            F.col("l_returnflag").alias("selected_source"),
            F.col("l_linestatus").alias("selected_model"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


_SPREAD = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "agg_10",
    """SELECT l_returnflag, name, min(value) AS min, max(value) AS max, median(value) AS median FROM
    (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
    ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE value) GROUP BY 1, 2""",
    "min max median",
)
def agg_10(spark, sf):
    return M.spread(V.table(spark, sf, "lineitem"), ["l_returnflag"], _SPREAD)


@query(
    "agg_11",
    """SELECT mutation_order, count(*) AS n, min(observed) AS lowest, max(observed) AS highest,
    stddev_samp(observed) AS sd, max(observed) - min(observed) AS value_range, median(observed) AS median,
    100 * avg(e) / stddev_samp(observed) AS mae_pct_sd, 100 * avg(e) / (max(observed) - min(observed)) AS mae_pct_range
    FROM (SELECT *, abs(observed - predicted) AS e FROM v_pred) GROUP BY 1""",
    "lowest highest sd value_range median mae_pct_sd mae_pct_range",
    "mutation_order",
)
def agg_11(spark, sf):
    p = V.predictions(spark, sf)
    width = F.max("observed") - F.min("observed")
    flat = p.groupBy("mutation_order").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("observed").alias("lowest"),
        F.max("observed").alias("highest"),
        F.stddev_samp("observed").alias("sd"),
        width.alias("value_range"),
        F.try_divide(F.lit(100.0) * F.avg(M.abs_error()), F.stddev_samp("observed")).alias("mae_pct_sd"),
        F.try_divide(F.lit(100.0) * F.avg(M.abs_error()), width).alias("mae_pct_range"),
    )
    return flat.join(
        group_quantiles(p, ["mutation_order"], "observed", {"median": 0.5}), "mutation_order"
    )


@query(
    "agg_19",
    """SELECT l_linestatus, l_linenumber::BIGINT AS setting, median(l_quantity) AS median_quantity,
    median(l_discount) AS median_discount, avg((l_tax < 0.05)::INT) AS success_fraction,
    avg((l_discount >= 0.1)::INT) AS boundary_fraction FROM lineitem GROUP BY 1, 2""",
    "median_quantity median_discount success_fraction boundary_fraction",
)
def agg_19(spark, sf):
    line = V.table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "setting")
    keys = ["l_linestatus", "setting"]
    flags = line.groupBy(*keys).agg(
        F.avg((F.col("l_tax") < 0.05).cast("double")).alias("success_fraction"),
        F.avg((F.col("l_discount") >= 0.1).cast("double")).alias("boundary_fraction"),
    )
    long = line.unpivot(keys, ["l_quantity", "l_discount"], "param", "value")
    med = group_quantiles(long, [*keys, "param"], "value", {"med": 0.5})
    wide = med.groupBy(*keys).agg(
        F.max(F.when(F.col("param") == "l_quantity", F.col("med"))).alias("median_quantity"),
        F.max(F.when(F.col("param") == "l_discount", F.col("med"))).alias("median_discount"),
    )
    return flags.join(wide, keys)


_DELTA_SQL = """SELECT key, s, a_err - b_err AS delta FROM (
SELECT key, 'A-N' AS s, abs(observed - a) AS a_err, abs(observed - n) AS b_err FROM v_paired UNION ALL
SELECT key, 'A-R', abs(observed - a), abs(observed - r) FROM v_paired UNION ALL
SELECT key, 'N-R', abs(observed - n), abs(observed - r) FROM v_paired)"""


def deltas(spark, sf):
    """Per-key error differences of three model pairs."""
    err = {m: F.abs(F.col("observed") - F.col(m)) for m in "anr"}
    pairs = [("A-N", "a", "n"), ("A-R", "a", "r"), ("N-R", "n", "r")]
    rows = F.array(
        *[F.struct(F.lit(s).alias("s"), (err[x] - err[y]).alias("delta")) for s, x, y in pairs]
    )
    return V.paired(spark, sf).select("key", F.explode(rows).alias("_r")).select("key", "_r.*")


@query(
    "agg_20",
    f"""SELECT verdict, count(*) AS n FROM (SELECT key, CASE WHEN bool_and(delta > 0) THEN 'improved'
    WHEN bool_and(delta < 0) THEN 'worsened' ELSE 'mixed' END AS verdict FROM ({_DELTA_SQL}) GROUP BY key) GROUP BY 1""",
)
def agg_20(spark, sf):
    per_key = (
        deltas(spark, sf)
        .groupBy("key")
        .agg(F.bool_and(F.col("delta") > 0).alias("up"), F.bool_and(F.col("delta") < 0).alias("down"))
    )
    verdict = F.when(F.col("up"), "improved").when(F.col("down"), "worsened").otherwise("mixed")
    return per_key.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_21",
    f"""WITH d AS ({_DELTA_SQL}) SELECT min(c) AS low, median(c) AS mid, max(c) AS high, sum(n)::BIGINT AS n FROM (
    SELECT a.s, b.s, corr(a.delta, b.delta) AS c, count(*) AS n FROM d a JOIN d b ON a.key = b.key AND a.s < b.s
    GROUP BY a.s, b.s)""",
    "low mid high",
)
def agg_21(spark, sf):
    m = M.pairwise_delta_correlation(deltas(spark, sf), "key", "s", "delta")
    return m.agg(
        F.min("correlation").alias("low"),
        F.median("correlation").alias("mid"),
        F.max("correlation").alias("high"),
        F.sum("n").alias("n"),
    )


@query("agg_22", _SCALE_SQL, "scale")
def agg_22(spark, sf):
    return M.sigma_scale(V.predictions(spark, sf), ["model"])


@query(
    "agg_23",
    f"""SELECT model, key, row_number() OVER (PARTITION BY model ORDER BY key) AS place, count(*) OVER (PARTITION BY model) AS n_outside
    FROM v_pred WHERE abs(observed - predicted) > {Z95} * sd""",
)
def agg_23(spark, sf):
    """The sorted list is a table with places: no model's keys are gathered into one value."""
    outside = M.abs_error() > F.lit(Z95) * F.col("sd")
    keys = V.predictions(spark, sf).where(outside).select("model", "key")
    return row_positions(keys, ["model"], [("key", False)], "place").withColumnRenamed(
        "total", "n_outside"
    )


@query(
    "agg_25",
    """WITH d AS (SELECT model, observed - predicted AS v FROM v_pred), e AS (SELECT min(v) - 0.2 AS lo, max(v) + 0.2 AS hi FROM d)
    SELECT model, least(floor((v - lo) / ((hi - lo) / 11.0)), 10)::BIGINT AS bin, count(*) AS n FROM d, e GROUP BY 1, 2""",
)
def agg_25(spark, sf):
    p = V.predictions(spark, sf).withColumn("v", F.col("observed") - F.col("predicted"))
    return M.shared_histogram(p, ["model"], "v")


_ROBUST_SQL = """SELECT {g}, id, CASE WHEN mad > 0 THEN 0.6745 * (x - med) / mad WHEN sd > 0 THEN (x - med) / sd
ELSE 0.0 END AS z FROM (SELECT *, median(abs(x - med)) OVER (PARTITION BY {g}) AS mad FROM (
SELECT *, median(x) OVER (PARTITION BY {g}) AS med, stddev_pop(x) OVER (PARTITION BY {g}) AS sd FROM ({t})))"""


def robust_sql(group: str, key: str, value: str, table: str) -> str:
    src = f"SELECT {group}, {key} AS id, {value}::DOUBLE AS x FROM {table}"
    return _ROBUST_SQL.format(g=group, t=src)


@query("agg_26", robust_sql("p_type", "p_partkey", "p_retailprice", "part"), "z")
def agg_26(spark, sf):
    part = V.table(spark, sf, "part").select("p_type", F.col("p_partkey").alias("id"), "p_retailprice")
    return M.robust_z(part, ["p_type"], "p_retailprice", "z").select("p_type", "id", "z")


_C = "(SELECT 0 AS g, * FROM v_cand)"


@query(
    "agg_27",
    f"""WITH z1 AS ({robust_sql('g', 'candidate_id', 'm1', _C)}), z2 AS ({robust_sql('g', 'candidate_id', 'm2', _C)}),
    z3 AS ({robust_sql('g', 'candidate_id', 'm3', _C)})
    SELECT id AS candidate_id, (z1.z + z2.z) / 2 AS structural, -z3.z AS other, 0.7 * (z1.z + z2.z) / 2 - 0.3 * z3.z AS score
    FROM z1 JOIN z2 USING (id) JOIN z3 USING (id)""",
    "structural other score",
)
def agg_27(spark, sf):
    return M.composite_score(
        V.candidates(spark, sf), "candidate_id", {"m1": True, "m2": True}, {"m3": False}
    )


@query(
    "agg_28",
    """WITH e AS (SELECT mutation_order, abs(observed - predicted) AS v FROM v_pred), q AS (SELECT mutation_order,
    quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY 1)
    SELECT mutation_order, q1, q2, q3, min(CASE WHEN i THEN v END) AS whisker_low, max(CASE WHEN i THEN v END) AS whisker_high,
    count_if(NOT i)::BIGINT AS n_outliers FROM (SELECT *, v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) AS i
    FROM e JOIN q USING (mutation_order)) GROUP BY 1, 2, 3, 4""",
    "q1 q2 q3 whisker_low whisker_high",
    "mutation_order",
)
def agg_28(spark, sf):
    p = V.predictions(spark, sf).select("mutation_order", M.abs_error().alias("v"))
    return M.box_statistics(p, ["mutation_order"], "v")


@query(
    "agg_29",
    """WITH t AS (SELECT sum(l_quantity) AS s, count(*) AS n FROM lineitem), g AS (SELECT l_linenumber, sum(l_quantity) AS gs,
    count(*) AS gn FROM lineitem GROUP BY 1) SELECT l_linenumber::BIGINT AS held_out, any_value(gn) AS n_test,
    any_value((s - gs) / (n - gn)) AS train_mean, avg(abs(l_quantity - (s - gs) / (n - gn))) AS mae
    FROM lineitem JOIN g USING (l_linenumber), t GROUP BY 1""",
    "train_mean mae",
)
def agg_29(spark, sf):
    from platewright.operators.folds import complement_mean_error

    line = V.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("held_out"), F.col("l_quantity").alias("y")
    )
    return complement_mean_error(line, "held_out", "y")


@query(
    "agg_31",
    """WITH m AS (SELECT model, mutation_order, avg(abs(observed - predicted)) AS mae FROM v_pred GROUP BY 1, 2)
    SELECT model, min(mae) AS low, median(mae) AS mid, max(mae) AS high,
    (SELECT count(*) FROM m a JOIN m b USING (mutation_order) WHERE a.model = 'A' AND b.model = 'R' AND a.mae < b.mae) AS a_beats_r
    FROM m GROUP BY 1""",
    "low mid high",
)
def agg_31(spark, sf):
    """Families are models, sets are mutation orders; the metric table has one row per (family, set)."""
    m = M.regression_metrics(V.predictions(spark, sf), ["model", "mutation_order"])
    wide = m.groupBy("mutation_order").agg(
        F.max(F.when(F.col("model") == "A", F.col("mae"))).alias("a"),
        F.max(F.when(F.col("model") == "R", F.col("mae"))).alias("r"),
    )
    wins = wide.agg(F.count_if(F.col("a") < F.col("r"))).scalar()
    return (
        m.groupBy("model")
        .agg(F.min("mae").alias("low"), F.median("mae").alias("mid"), F.max("mae").alias("high"))
        .withColumn("a_beats_r", wins)
    )


@query("agg_32", "SELECT model, count(DISTINCT key) AS n_keys FROM v_pred GROUP BY 1")
def agg_32(spark, sf):
    return (
        V.predictions(spark, sf).groupBy("model").agg(F.countDistinct("key").alias("n_keys"))
    )


@query(
    "mth_1",
    """SELECT model, key, abs(observed - predicted) AS abs_error,
    CASE WHEN observed > 0 THEN abs(observed - predicted) / observed END AS relative_error FROM v_pred""",
    "abs_error relative_error",
)
def mth_1(spark, sf):
    return V.predictions(spark, sf).select(
        "model", "key", M.abs_error().alias("abs_error"), M.relative_error().alias("relative_error")
    )


@query(
    "mth_2",
    f"""WITH s AS ({_SCALE_SQL}) SELECT model, key, (observed - predicted) / sd AS z_raw,
    (observed - predicted) / (sd * scale) AS z_calibrated FROM v_pred JOIN s USING (model)""",
    "z_raw z_calibrated",
)
def mth_2(spark, sf):
    p = V.predictions(spark, sf)
    scaled = M.apply_scale(p, M.sigma_scale(p, ["model"]), ["model"])
    return scaled.select(
        "model",
        "key",
        M.standardised_residual().alias("z_raw"),
        M.standardised_residual("sd_calibrated").alias("z_calibrated"),
    )


@query(
    "mth_3",
    f"""SELECT model, key, predicted - {Z95} * sd AS lower, predicted + {Z95} * sd AS upper, 2 * {Z95} * sd AS width FROM v_pred""",
    "lower upper width",
)
def mth_3(spark, sf):
    return V.predictions(spark, sf).select(
        "model", "key", *[c.alias(n) for n, c in M.interval().items()]
    )


@query(
    "mth_4",
    f"""WITH s AS ({_SCALE_SQL}) SELECT model, key, sd * scale AS sd_calibrated FROM v_pred JOIN s USING (model)""",
    "sd_calibrated",
)
def mth_4(spark, sf):
    p = V.predictions(spark, sf)
    return M.apply_scale(p, M.sigma_scale(p, ["model"]), ["model"]).select(
        "model", "key", "sd_calibrated"
    )
