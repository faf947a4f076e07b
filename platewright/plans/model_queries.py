"""Model-evaluation queries: folds, baselines, nested selection and grouped Gaussian processes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from platewright.functions import variants as X
from platewright.functions.gp import BOUNDS
from platewright.operators import features as P
from platewright.operators import folds, gp_models as G, holdouts, metrics as M, models as L, reshape as S
from platewright.operators.forests import forest_cv
from platewright.operators.stability import stable, written
from platewright.plans import views as V
from platewright.plans.metric_queries import metrics_sql, rho_sql
from platewright.plans.registry import query
from platewright.plans.similarity_queries import SIGMA_EPI, SIGMA_MAIN

K = 4
KS = [1, 3, 5, 7]
_H = "('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT"
_LF = _H.format("l_orderkey") + " % 5"
FIXED = {"lengthscale_multiplier": 1.0, "sigma_main": 1.0, "sigma_epi": 0.5, "sigma_noise": 0.3}
FAMILIES = [
    {"name": "additive", "family": "additive", "starts": 3},
    {"name": "epistatic", "family": "epistatic", "starts": 3},
]


def lines(spark, sf):
    """lineitem numerics with a fold by order."""
    line = V.table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.col("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("x"),
        F.array("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double")).alias("vec"),
    )
    return folds.assign_folds(line, "l_orderkey", 5)


def folded_assays(spark, sf, k=K):
    return folds.assign_folds(V.assays(spark, sf), "vec_id", k)


@query(
    "mod_1",
    f"SELECT {_LF} AS fold, count(*) AS n, count(DISTINCT l_orderkey) AS n_keys FROM lineitem GROUP BY 1",
)
def mod_1(spark, sf):
    return lines(spark, sf).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("n_keys")
    )


@query(
    "mod_3",
    f"""WITH r AS (SELECT {_LF} AS fold, l_quantity AS y FROM lineitem), t AS (SELECT fold, count(*) AS n, sum(y) AS s FROM r GROUP BY 1)
    SELECT fold, any_value(tn - n) AS n_train, any_value((ts - s) / (tn - n)) AS predicted, avg(abs(y - (ts - s) / (tn - n))) AS mae
    FROM r JOIN (SELECT *, sum(n) OVER ()::BIGINT AS tn, sum(s) OVER () AS ts FROM t) USING (fold) GROUP BY 1""",
    "predicted mae",
)
def mod_3(spark, sf):
    rows = lines(spark, sf).select("fold", F.col("x").alias("q"))
    p = folds.train_mean_baseline(rows, [], "fold", "q")
    return p.groupBy("fold", "n_train", "predicted").agg(
        F.avg(F.abs(F.col("q") - F.col("predicted"))).alias("mae")
    )


# The penalties tried.
RIDGE_ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]


@query(
    "mod_4",
    f"""WITH r AS (SELECT {_LF} AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT i AS fold, count(*) AS n, avg(x) AS mx, avg(y) AS my,
    stddev_pop(x) AS sx, covar_pop(x, y) AS cxy FROM r, range(5) AS t(i) WHERE r.fold <> i GROUP BY 1)
    SELECT fold, alpha, sqrt(avg((y - (my + (n * cxy / sx) / (n + alpha) * (x - mx) / sx)) ** 2)) / 1000 AS rmse_thousands
    FROM r JOIN f USING (fold), (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0), (100.0)) AS a(alpha) GROUP BY 1, 2""",
    "alpha rmse_thousands",
)
def mod_4(spark, sf):
    """One feature, so that the closed form is an oracle; MOD_4_wide uses the same code on four."""
    rows = lines(spark, sf).withColumn("vx", F.array("x"))
    p = ridge_cv(rows, "vx", RIDGE_ALPHAS)
    return p.groupBy("fold", "alpha").agg(
        (F.sqrt(F.avg(F.pow(F.col("y") - F.col("predicted"), F.lit(2)))) / 1000).alias("rmse_thousands")
    )


def ridge_cv(rows, vec, alphas):
    """Train moments of every fold from one pass, tiny solves, predictions by join."""
    joint = rows.withColumn("_xy", F.concat(F.col(vec), F.array("y")))
    train = P.complement_second_moments(P.second_moments(joint, ["fold"], "_xy"), [], "fold")
    return L.linear_predictions(rows, L.ridge(train, ["fold"], alphas), ["fold"], vec)


def nested_ridge_report(spark, sf, vec):
    """Chosen penalty, its inner error and the error on the held-out fold, per outer fold."""
    rows = lines(spark, sf).withColumn("one", F.array("x"))
    p, criteria = L.nested_ridge(rows, "fold", 5, vec, "y", RIDGE_ALPHAS)
    outer = p.groupBy("fold", "alpha").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.abs(F.col("y") - F.col("predicted"))) / 1000).alias("mae_thousands")
    )
    chosen = criteria.select(F.col("outer").alias("fold"), "alpha", (F.col("inner_mae") / 1000).alias("inner_mae_thousands"))
    return outer.join(chosen, ["fold", "alpha"])


HOLDOUT_FOLDS = 3


def measured_variants(spark, sf):
    """Variants with their positions, a target and four numbers per row of the part table."""
    parts = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("variant_id"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"),
        F.array(
            F.col("p_size").cast("double"), F.length("p_name").cast("double"), F.length("p_type").cast("double"),
            F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double"),
        ).alias("vec"),
    )
    v = V.variants(spark, sf).select("variant_id", X.positions_of(X.parse_mutations("mutations")).alias("positions"))
    return folds.assign_folds(v.join(parts, "variant_id"), "variant_id", HOLDOUT_FOLDS)


def holdout_refits(spark, sf, one):
    rows = measured_variants(spark, sf)
    rows = rows.withColumn("vec", F.array("x")) if one else rows
    return holdouts.position_refits(rows, "variant_id", "positions", "fold", HOLDOUT_FOLDS, "vec", "y", RIDGE_ALPHAS)


@query(
    "mod_2_refit",
    f"""WITH r AS (SELECT variant_id, list_distinct(poss) AS ps, p_size::DOUBLE AS x, p_retailprice AS y, {_H.format("variant_id")} % {HOLDOUT_FOLDS} AS fold
    FROM v_parsed JOIN part ON p_partkey = variant_id), u AS (SELECT DISTINCT unnest(ps) AS p FROM r), a AS (SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0])::DOUBLE AS alpha),
    t AS (SELECT p, i, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy
    FROM r, u, range(-1, {HOLDOUT_FOLDS}) AS q(i) WHERE NOT list_contains(ps, p) AND fold <> i GROUP BY 1, 2),
    e AS (SELECT r.*, p, i, n, my, alpha, my + (n * cxy / sx) / (n + alpha) * (x - mx) / sx AS predicted FROM r, t, a
    WHERE (i = -1 AND list_contains(ps, p) AND n >= 5) OR (i = fold AND NOT list_contains(ps, p))),
    c AS (SELECT p, alpha, avg(abs(y - predicted)) AS inner_mae FROM e WHERE i >= 0 GROUP BY 1, 2),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p ORDER BY inner_mae, alpha) = 1)
    SELECT p AS position, count(*) AS n, avg(abs(y - predicted)) AS mae, sqrt(avg((y - predicted) ** 2)) AS rmse, avg(abs(y - my)) AS mae_train_mean,
    median(abs(y - predicted)) AS median_abs_error, alpha, any_value(inner_mae) AS inner_mae FROM e JOIN b USING (p, alpha) WHERE i = -1 GROUP BY p, alpha""",
    "mae rmse mae_train_mean median_abs_error alpha inner_mae",
    "position",
)
def mod_2_refit(spark, sf):
    """Strict hold-out of every position, ridge on one number refitted on the rows without it, against the train mean."""
    return holdouts.holdout_report(*holdout_refits(spark, sf, one=True))


@query("mod_2_wide")
def mod_2_wide(spark, sf):
    """The predictions of the same hold-outs from four numbers; a row is predicted once per position it carries."""
    return holdout_refits(spark, sf, one=False)[0]


@query("mod_4_wide")
def mod_4_wide(spark, sf):
    """Four features; the penalty is chosen by inner folds, never on the held-out rows."""
    return nested_ridge_report(spark, sf, "vec")


@query(
    "mod_8_ridge",
    f"""WITH r AS (SELECT {_LF} AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), a AS (SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0])::DOUBLE AS alpha),
    f AS (SELECT o, i, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy
    FROM r, range(5) AS p(o), range(5) AS q(i) WHERE fold <> o AND fold <> i GROUP BY 1, 2),
    e AS (SELECT o, i, fold, alpha, abs(y - (my + (n * cxy / sx) / (n + alpha) * (x - mx) / sx)) AS e FROM r JOIN f ON fold = i, a),
    c AS (SELECT o, alpha, avg(e) AS mae FROM e WHERE o <> i GROUP BY 1, 2), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o ORDER BY mae, alpha) = 1)
    SELECT b.o AS fold, b.alpha, count(*) AS n, avg(e) / 1000 AS mae_thousands, any_value(b.mae) / 1000 AS inner_mae_thousands
    FROM b JOIN e ON e.o = b.o AND e.i = b.o AND e.alpha = b.alpha GROUP BY 1, 2""",
    "alpha mae_thousands inner_mae_thousands",
)
def mod_8_ridge(spark, sf):
    """Nested ridge on one feature, where the solution has a closed form."""
    return nested_ridge_report(spark, sf, "one")


_VF = f"({_H.format('vec_id')} % {K})"
_KNN = f"""v AS (SELECT assay, vec_id, vec, y, {_VF} AS fold FROM v_assay),
sp AS (SELECT o.i AS outer_, n.i AS inner_ FROM range({K}) AS o(i), range({K}) AS n(i) {{only}}),
rows AS (SELECT v.*, outer_, inner_, fold = inner_ AS test FROM v, sp WHERE inner_ = outer_ OR fold <> outer_),
sds AS (SELECT assay, outer_, inner_, list(CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY dim) AS sd FROM (
SELECT assay, outer_, inner_, dim, stddev_pop(vec[dim]) AS s FROM rows, range(1, 65) AS d(dim) WHERE NOT test GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
scl AS (SELECT assay, outer_, inner_, test, vec_id, y, [a / b FOR a, i IN vec, b IN [sd[i]]] AS z FROM rows JOIN sds USING (assay, outer_, inner_))"""
_KNN = _KNN.replace("[a / b FOR a, i IN vec, b IN [sd[i]]]", "list_transform(list_zip(vec, sd), lambda p: p[1] / p[2])")
_KNN += f""",
prs AS (SELECT a.assay, a.outer_, a.inner_, a.vec_id, a.y AS observed, b.y AS yb, b.vec_id AS id_b, list_distance(a.z, b.z) AS d
FROM scl a JOIN scl b ON a.assay = b.assay AND a.outer_ = b.outer_ AND a.inner_ = b.inner_ AND a.test AND NOT b.test),
rk AS (SELECT *, row_number() OVER (PARTITION BY assay, outer_, inner_, vec_id ORDER BY d, id_b) AS r, count(*) OVER (PARTITION BY assay, outer_, inner_, vec_id) AS n FROM prs),
knn AS (SELECT assay, outer_, inner_, vec_id, observed, k, CASE WHEN min(d) = 0 THEN avg(yb) FILTER (d = 0) ELSE sum(yb / d) / sum(1 / d) END AS predicted
FROM rk, (VALUES (1), (3), (5), (7)) AS g(k) WHERE r <= k AND k <= n GROUP BY 1, 2, 3, 4, 5, 6)"""


def neighbours(spark, sf, nested):
    rows = folded_assays(spark, sf)
    return L.neighbour_predictions(rows, ["assay"], "fold", "vec_id", "y", KS, K, nested)


@query(
    "mod_5",
    "WITH " + _KNN.format(only="WHERE o.i = n.i") + " SELECT assay, vec_id, k, observed, predicted FROM knn",
    "observed predicted",
    "k",
    digits=5,
)
def mod_5(spark, sf):
    return neighbours(spark, sf, nested=False).select("assay", "vec_id", "k", "observed", "predicted")


@query("mod_6")
def mod_6(spark, sf):
    rows = lines(spark, sf)
    joint = rows.withColumn("_xy", F.concat("vec", F.array("y")))
    train = P.complement_second_moments(P.second_moments(joint, ["fold"], "_xy"), [], "fold")
    p = L.linear_predictions(rows, L.bayesian_ridge(train, ["fold"]), ["fold"], "vec")
    return p.groupBy("fold", "noise_precision", "weight_precision").agg(
        F.avg(F.abs(F.col("y") - F.col("predicted"))).alias("mae")
    )


@query("mod_7")
def mod_7(spark, sf):
    """Fewer and shallower trees than the defaults keep the example short."""
    rows = lines(spark, sf).select("l_orderkey", "fold", "y", "vec")
    p = forest_cv(rows, "l_orderkey", "vec", "y", "fold", 5, trees=10, depth=6)
    return p.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("predicted"))).alias("mae")
    )


@query(
    "mod_8",
    "WITH "
    + _KNN.format(only="")
    + """, im AS (SELECT assay, outer_, k, avg(abs(observed - predicted)) AS inner_mae FROM knn WHERE inner_ <> outer_ GROUP BY 1, 2, 3),
    best AS (SELECT * FROM im QUALIFY row_number() OVER (PARTITION BY assay, outer_ ORDER BY inner_mae, k) = 1)
    SELECT assay, vec_id, k AS selected_k, inner_mae, observed, predicted FROM knn JOIN best USING (assay, outer_, k) WHERE inner_ = outer_""",
    "inner_mae observed predicted",
    "selected_k",
    digits=5,
)
def mod_8(spark, sf):
    p = stable(neighbours(spark, sf, nested=True))
    out = L.nested_choice(p, ["assay"], "vec_id", "k")
    return out.select(
        "assay", "vec_id", F.col("k").alias("selected_k"), "inner_mae", "observed", "predicted"
    )


def line_fit(train: pd.DataFrame, test: pd.DataFrame, params: dict) -> np.ndarray:
    """Least squares on one vector entry; the plug-in scorer of the examples."""
    d = params["dim"]
    xa = np.vstack(train["vec"])[:, d]
    xb = np.vstack(test["vec"])[:, d]
    y = train["y"].to_numpy()
    slope = ((xa - xa.mean()) * (y - y.mean())).sum() / ((xa - xa.mean()) ** 2).sum()
    return y.mean() + slope * (xb - xa.mean())


_OLS = f"""WITH v AS (SELECT assay, vec_id, vec[6] AS x, y, {_VF} AS fold FROM v_assay), m AS (SELECT assay, i AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
FROM v, range({K}) AS f(i) WHERE v.fold <> i GROUP BY 1, 2) SELECT assay, vec_id, y AS observed, a + b * x AS predicted FROM v JOIN m USING (assay, fold)"""


def _outer_cv(spark, sf):
    p = L.fixed_outer_cv(folded_assays(spark, sf), ["assay"], "fold", "vec_id", "y", line_fit, {"dim": 5}, K)
    return p.select("assay", "vec_id", "observed", "predicted")


@query("mod_9", _OLS, "observed predicted")
def mod_9(spark, sf):
    return _outer_cv(spark, sf)


@query("mod_10")
def mod_10(spark, sf):
    w = G.fit_groups(V.assays(spark, sf), "assay", "vec_id", FIXED, V.N_COMPONENTS)
    return w.select("assay", "train_id", "alpha", "y_mean", "y_sd", "lengthscale", "problem")


_TEST = f"({_H.format('{0}vec_id')} % 5)"


@query(
    "mod_11",
    f"""WITH tr AS (SELECT assay, avg(y) AS m, stddev_samp(y) AS s, count(*) AS n FROM v_assay WHERE {_TEST.format('')} <> 0 GROUP BY 1),
    k AS (SELECT assay, a.vec_id AS vec_id, b.vec_id AS train_id, exp(-0.5 * list_distance(a.x, b.x) ** 2 / 0.64) AS k FROM v_comp a JOIN v_comp b USING (assay, component)
    WHERE {_TEST.format('a.')} = 0 AND {_TEST.format('b.')} <> 0), t AS (SELECT assay, vec_id, train_id, {SIGMA_MAIN**2} * avg(k) + {SIGMA_EPI**2} * (sum(k) ** 2 - sum(k * k)) / 12.0 AS sim FROM k GROUP BY 1, 2, 3)
    SELECT assay, t.vec_id, any_value(m) + any_value(s) * sum(sim * (y - m) / s / n) AS predicted FROM t JOIN tr USING (assay) JOIN (SELECT vec_id AS train_id, y FROM v_assay) USING (train_id) GROUP BY 1, 2""",
    "predicted",
)
def mod_11(spark, sf):
    """The scoring join with weights that SQL can also produce: centred targets over n."""
    rows = folds.assign_folds(V.assays(spark, sf), "vec_id", 5)
    train, test = rows.where(F.col("fold") != 0), rows.where(F.col("fold") == 0)
    stats = train.groupBy("assay").agg(
        F.avg("y").alias("y_mean"), F.stddev_samp("y").alias("y_sd"), F.count(F.lit(1)).alias("_n")
    )
    weights = train.join(stats, "assay").select(
        "assay",
        F.col("vec_id").alias("train_id"),
        ((F.col("y") - F.col("y_mean")) / F.col("y_sd") / F.col("_n")).alias("alpha"),
        "y_mean",
        "y_sd",
    )
    return G.score_candidates(
        test, train, weights, "assay", "vec_id", F.lit(0.8), SIGMA_MAIN, SIGMA_EPI, V.N_COMPONENTS, V.COMPONENT_DIM
    )


@query("mod_11_gp")
def mod_11_gp(spark, sf):
    """Fitted weights scored by join, next to the dense prediction with its two SDs; a problem where there is no fit."""
    rows = folds.assign_folds(V.assays(spark, sf), "vec_id", 5)
    train, test = rows.where(F.col("fold") != 0), rows.where(F.col("fold") == 0)
    w = G.fit_groups(train, "assay", "vec_id", FIXED, V.N_COMPONENTS)
    joined = G.score_candidates(
        test, train, w, "assay", "vec_id", F.col("lengthscale"), 1.0, 0.5, V.N_COMPONENTS, V.COMPONENT_DIM
    )
    roles = rows.withColumn("role", F.when(F.col("fold") == 0, "test").otherwise("train"))
    settings = [{"name": "fixed", "family": "epistatic", "params": FIXED}]
    dense = G.predict_groups(roles, ["assay"], "vec_id", settings, V.N_COMPONENTS)
    return dense.select(
        "assay", "vec_id", F.col("predicted").alias("dense_mean"), "sd_latent", "sd_observed", "problem"
    ).join(joined, ["assay", "vec_id"], "left")


@query("mod_11_sd")
def mod_11_sd(spark, sf):
    """Candidates with mean, latent, observed and calibrated SD; the calibration comes from the train rows' own folds."""
    rows = folds.assign_folds(V.assays(spark, sf), "vec_id", 5)
    train, test = rows.where(F.col("fold") != 0), rows.where(F.col("fold") == 0)
    packed = G.pack_models(train, "assay", "vec_id", FIXED, V.N_COMPONENTS)
    scored = G.score_packed(test, packed, "assay", "vec_id", V.N_COMPONENTS)
    settings = [{"name": "fixed", "family": "epistatic", "params": FIXED}]
    again = folds.assign_folds(train.drop("fold"), "vec_id", 3)
    cv = G.predict_splits(again, "assay", "fold", "vec_id", settings, V.N_COMPONENTS, 3, nested=False)
    return M.apply_scale(scored, M.sigma_scale(cv, ["assay"], "sd_observed"), ["assay"], "sd_observed")


@query("mod_12")
def mod_12(spark, sf):
    best = G.search_groups(V.assays(spark, sf), "assay", "vec_id", "epistatic", 5, V.N_COMPONENTS)
    return G.boundary_hits(best)


_SPAN = {n: (float(np.log(lo)), float(np.log(hi))) for n, (lo, hi) in BOUNDS.items()}


def _hit_sql(name: str, u: str) -> str:
    lo, hi = _SPAN[name]
    v = f"({lo!r} + {u} * {hi - lo!r})"
    return f"(least(abs({v} - ({lo!r})), abs({hi!r} - {v})) <= 0.02 * {hi - lo!r})"


@query(
    "mod_13",
    f"""SELECT vec_id, {_hit_sql('lengthscale_multiplier', 'u')} AS hit_lengthscale_multiplier, {_hit_sql('sigma_noise', 'w')} AS hit_sigma_noise,
    {_hit_sql('lengthscale_multiplier', 'u')} OR {_hit_sql('sigma_noise', 'w')} AS any_hit
    FROM (SELECT vec_id, {_H.format("'u' || vec_id")} / 4294967296.0 AS u, {_H.format("'w' || vec_id")} / 4294967296.0 AS w FROM embeddings)""",
)
def mod_13(spark, sf):
    """Parameters spread log-uniformly over their bounds, one pair per embedding row."""
    from platewright.functions.common import TWO_32, hash32

    def spread(tag, name):
        lo, hi = _SPAN[name]
        u = hash32(F.concat(F.lit(tag), F.col("vec_id").cast("string"))) / F.lit(TWO_32)
        return F.exp(F.lit(lo) + u * F.lit(hi - lo)).alias(name)

    e = V.table(spark, sf, "embeddings").select(
        "vec_id", spread("u", "lengthscale_multiplier"), spread("w", "sigma_noise")
    )
    return G.boundary_hits(e).select("vec_id", "hit_lengthscale_multiplier", "hit_sigma_noise", "any_hit")


def nested(spark, sf, settings=FAMILIES, k=3):
    """The shared nested table, materialised once because several results read it."""
    rows = folded_assays(spark, sf, k)
    return stable(G.nested_predictions(rows, "assay", "fold", "vec_id", settings, V.N_COMPONENTS, k))


@query("mod_14")
def mod_14(spark, sf):
    """Setting x fold sweep over all outer splits, best setting per assay."""
    settings = [*FAMILIES, {"name": "additive-pca3", "family": "additive", "pca": 3, "starts": 3}]
    rows = folded_assays(spark, sf, 3)
    p = G.predict_splits(rows, "assay", "fold", "vec_id", settings, V.N_COMPONENTS, 3, nested=False)
    m = G.setting_metrics(p, ["assay", "setting"])
    return S.best_by(m, ["assay"], ["mae", "nlpd", "rmse"], "setting")


@query("mod_15")
def mod_15(spark, sf):
    out = G.nested_selection(nested(spark, sf), "assay")
    return out.select(
        "assay", "outer", "vec_id", "setting", "observed", "predicted", "sd_observed", "scale", "sd_calibrated"
    )


@query("mod_16")
def mod_16(spark, sf):
    """Linear prior mean in a score plus GP residual, every fold predicted once; the score is one vector entry.

    Intercept and slope belong to the fit that predicts.
    """
    rows = folds.assign_folds(V.assays(spark, sf), "vec_id", 5).withColumn("score", F.col("vec")[0])
    settings = [{"name": "prior", "family": "epistatic", "starts": 3}]
    p = G.predict_splits(rows, "assay", "fold", "vec_id", settings, V.N_COMPONENTS, 5, nested=False, score="score")
    return p.select(
        "assay", F.col("outer").alias("fold"), "vec_id", "observed", "predicted", "sd_latent", "sd_observed",
        "objective", "intercept", "slope", *G.PARAMS,
    )


# The axes of the grid.
GRID_LENGTHS, GRID_MAIN, GRID_EPI, GRID_NOISE = (0.2, 0.5, 1.0), (0.5, 1.0), (1.0, 2.0, 4.0), (0.3, 0.5, 1.0)


def fixed_grid():
    """18 additive and 54 epistatic points."""
    return [
        {"family": family, "lengthscale": ell, "sigma_main": main, "sigma_epi": epi, "sigma_noise": noise}
        for family, epis in (("additive", (0.0,)), ("epistatic", GRID_EPI))
        for ell in GRID_LENGTHS for main in GRID_MAIN for epi in epis for noise in GRID_NOISE
    ]


@query("mod_17")
def mod_17(spark, sf):
    """Best point of the whole grid per family, assay and outer fold under nested selection, and the family gain."""
    outer = G.grid_selection(folded_assays(spark, sf, 3), "assay", "fold", "vec_id", fixed_grid(), V.N_COMPONENTS, 3)
    wide = S.widen(
        outer.withColumn("e", F.abs(F.col("observed") - F.col("predicted"))),
        ["assay", "vec_id"],
        "family",
        ["additive", "epistatic"],
        "e",
    )
    return wide.withColumn("gain", F.col("additive") - F.col("epistatic"))


@query("mod_18")
def mod_18(spark, sf):
    """Each vector component as its own descriptor set; re-run sets replace their earlier rows."""
    sets = V.components(V.assays(spark, sf), ("assay", "vec_id", "y", "sem"))
    rows = folds.assign_folds(
        sets.select(
            F.concat_ws(":", "assay", "component").alias("unit"), "vec_id", "y", "sem", F.col("x").alias("vec")
        ),
        "vec_id",
        3,
    )
    settings = [
        {"name": "global", "family": "global", "starts": 3},
        {"name": "global-fixed", "family": "global", "params": {"lengthscale_multiplier": 2.0}},
    ]

    def sweep(some):
        p = G.predict_splits(some, "unit", "fold", "vec_id", settings, 1, 3, nested=False)
        p = p.withColumn("component", F.split("unit", ":")[1].cast("int"))
        return G.setting_metrics(p, ["component", "setting"])

    first = stable(sweep(rows).withColumn("rerun", F.lit(False)))
    # One set is swept anew and takes the place of its rows.
    again = sweep(rows.where(F.endswith("unit", F.lit(":2")))).withColumn("rerun", F.lit(True))
    return S.upsert(first, again, ["component", "setting"])


_LONG = """SELECT 'a' AS model, key, observed, a AS predicted FROM v_paired UNION ALL SELECT 'n', key, observed, n FROM v_paired UNION ALL
SELECT 'r', key, observed, r FROM v_paired UNION ALL SELECT 'score', key, observed, a / 100 FROM v_paired"""


@query(
    "mod_19",
    f"""WITH t AS ({_LONG}), m AS ({metrics_sql('t')}), s AS ({rho_sql('t')}), b AS (SELECT model AS best FROM m WHERE model <> 'score' ORDER BY mae, model LIMIT 1),
    g AS (SELECT avg(e.re - e.be) AS gain FROM (SELECT key, max(CASE WHEN model = 'n' THEN abs(observed - predicted) END) AS re,
    max(CASE WHEN model = best THEN abs(observed - predicted) END) AS be FROM t, b GROUP BY 1) e)
    SELECT model, n, CASE WHEN model <> 'score' THEN mae END AS mae, pearson, spearman, model = best AS is_best, TRUE AS complete, gain AS mean_gain
    FROM m JOIN s USING (model), b, g""",
    "mae pearson spearman mean_gain",
)
def mod_19(spark, sf):
    wide = written(V.paired(spark, sf), "paired")
    tables = {m: wide.select("key", "observed", F.col(m).alias("predicted")) for m in "anr"}
    tables["score"] = wide.select("key", "observed", (F.col("a") / F.lit(100.0)).alias("predicted"))
    parts = L.assemble_comparators(S.stack_tables(tables, "model"), "key", "n", F.col("model") == "score")
    gain = parts["gains"].agg(F.avg("gain")).scalar()
    return (
        parts["metrics"]
        .join(parts["coverage"].select("model", "complete"), "model")
        .select("model", "n", "mae", "pearson", "spearman", "is_best", "complete")
        .withColumn("mean_gain", gain)
    )


@query("mod_20")
def mod_20(spark, sf):
    """One deployment row per assay, from all of its rows.

    The setting is the one of smallest cross-validated error over all rows; its parameters are optimised on all
    rows; the SD scale comes from that setting's cross-validation; ``n`` counts rows.
    """
    assays = V.assays(spark, sf)
    rows = folds.assign_folds(assays, "vec_id", 3)
    cv = stable(G.predict_splits(rows, "assay", "fold", "vec_id", FAMILIES, V.N_COMPONENTS, 3, nested=False))
    chosen = S.best_by(G.setting_metrics(cv, ["assay", "setting"]), ["assay"], ["mae", "nlpd", "rmse"], "setting")
    fits = [
        G.search_groups(assays, "assay", "vec_id", f["family"], f["starts"], V.N_COMPONENTS)
        .withColumn("setting", F.lit(f["name"]))
        for f in FAMILIES
    ]
    fitted = fits[0].unionByName(fits[1])
    used = cv.join(chosen.select("assay", "setting"), ["assay", "setting"])
    return chosen.join(fitted, ["assay", "setting"]).join(M.sigma_scale(used, ["assay"], "sd_observed"), "assay")


@query(
    "udf_1",
    "SELECT vec_id, component, sqrt(list_inner_product(x, x)) AS value FROM v_comp",
    "value",
    "component",
)
def udf_1(spark, sf):
    """A feature source is any DataFrame -> DataFrame callable; this one runs an external function."""

    def source(keys):
        def run(batches):
            for pdf in batches:
                x = np.vstack(pdf["x"].to_numpy())
                yield pdf[["vec_id", "component"]].assign(value=np.sqrt((x * x).sum(axis=1)))

        return keys.mapInPandas(run, "vec_id bigint, component int, value double")

    v = V.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )
    return source(V.components(v, ("vec_id",)))


@query("udf_2", _OLS, "observed predicted")
def udf_2(spark, sf):
    return _outer_cv(spark, sf)


@query(
    "udf_3",
    f"""WITH v AS (SELECT assay, vec_id, y, {_VF} AS fold FROM v_assay), m AS (SELECT assay, i AS fold, avg(y) AS p FROM v, range({K}) AS f(i) WHERE v.fold <> i GROUP BY 1, 2)
    SELECT assay, vec_id, y AS observed, p AS predicted FROM v JOIN m USING (assay, fold)""",
    "observed predicted",
)
def udf_3(spark, sf):
    """An inline fit-and-predict lambda."""
    mean = lambda train, test, params: np.full(len(test), train["y"].mean())
    p = L.fixed_outer_cv(folded_assays(spark, sf), ["assay"], "fold", "vec_id", "y", mean, {}, K)
    return p.select("assay", "vec_id", "observed", "predicted")


