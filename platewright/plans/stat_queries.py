"""Statistical-inference queries over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions.normal import upper_tail_sql
from platewright.operators import gp_models as G, metrics as M, reshape as S, resampling as R, stats as T
from platewright.operators.stats import poisson_thresholds
from platewright.operators.stability import stable
from platewright.plans import views as V
from platewright.plans.metric_queries import rho_sql
from platewright.plans.registry import query
from platewright.plans.similarity_queries import _CORR, correlations

DRAWS = 10_000
RHO_DRAWS = 10_000
PERMS = 1000
SUBSETS = 1000
POISSON_DRAWS = 1000
_H = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
_H60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"


def gaps(spark, sf):
    e = {m: F.abs(F.col("observed") - F.col(m)) for m in "anr"}
    return V.paired(spark, sf).select(
        F.lit("all").alias("scope"),
        "key",
        (e["n"] - e["a"]).alias("a_vs_n"),
        (e["r"] - e["a"]).alias("a_vs_r"),
    )


_GAPS = """g AS (SELECT key, abs(observed - n) - abs(observed - a) AS a_vs_n, abs(observed - r) - abs(observed - a) AS a_vs_r,
row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS total FROM v_paired)"""
_CI = """SELECT statistic, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high FROM
(UNPIVOT d ON a_vs_n, a_vs_r INTO NAME statistic VALUE v) GROUP BY 1"""


@query(
    "sta_1",
    f"""WITH {_GAPS}, s AS (SELECT draw, {_H60.format("draw || '|' || pos")} % total AS slot FROM g, range({DRAWS}) AS r(draw)),
    d AS (SELECT draw, avg(a_vs_n) AS a_vs_n, avg(a_vs_r) AS a_vs_r FROM s JOIN g ON pos = slot GROUP BY 1) {_CI}""",
    "ci_low ci_high",
)
def sta_1(spark, sf):
    means = T.bootstrap_means(gaps(spark, sf), ["scope"], "key", ["a_vs_n", "a_vs_r"], DRAWS)
    return T.percentile_interval(means, ["scope"], ["a_vs_n", "a_vs_r"]).drop("scope")


# Draws of the exact bootstrap, which needs no row per draw.
EXACT_DRAWS = 10_000


@query("sta_1_exact")
def sta_1_exact(spark, sf):
    """Exact n-of-n resamples dealt down a tree of blocks."""
    means = R.exact_bootstrap_means(gaps(spark, sf), ["scope"], "key", ["a_vs_n", "a_vs_r"], EXACT_DRAWS)
    return T.percentile_interval(means, ["scope"], ["a_vs_n", "a_vs_r"]).drop("scope")


_POISSON = " + ".join(f"(u >= '{t}')::INT" for t in poisson_thresholds())


@query(
    "sta_1_poisson",
    f"""WITH {_GAPS}, w AS (SELECT *, {_POISSON} AS w FROM (SELECT *, substr(md5((draw // 4) || '|' || key), 8 * (draw % 4) + 1, 8) AS u
    FROM g, range({POISSON_DRAWS}) AS r(draw))), d AS (SELECT draw, sum(a_vs_n * w) / sum(w) AS a_vs_n, sum(a_vs_r * w) / sum(w) AS a_vs_r FROM w GROUP BY 1) {_CI}""",
    "ci_low ci_high",
)
def sta_1_poisson(spark, sf):
    means = T.poisson_bootstrap_means(gaps(spark, sf), ["scope"], "key", ["a_vs_n", "a_vs_r"], POISSON_DRAWS)
    return T.percentile_interval(means, ["scope"], ["a_vs_n", "a_vs_r"]).drop("scope")


_DIFF = """df AS (SELECT a.model AS focus, b.model AS against, a.key, abs(a.observed - a.predicted) AS focus_error, abs(b.observed - b.predicted) AS against_error,
abs(b.observed - b.predicted) - abs(a.observed - a.predicted) AS difference FROM v_pred a JOIN v_pred b ON a.key = b.key AND a.model <> b.model)"""


def differences(spark, sf):
    p = V.predictions(spark, sf).withColumn("e", M.abs_error())
    return T.paired_differences(p, "model", "key", "e")


@query(
    "sta_2",
    f"""WITH {_DIFF} SELECT focus, against, count(*) AS n, avg(focus_error) AS focus_mae, avg(against_error) AS against_mae, avg(difference) AS delta_mean,
    count_if(difference > 0)::BIGINT AS n_focus_better, median(difference) AS delta_median FROM df GROUP BY 1, 2""",
    "focus_mae against_mae delta_mean delta_median",
)
def sta_2(spark, sf):
    return T.paired_summary(differences(spark, sf), ["focus", "against"])


def sta_2_interval_rows(spark, sf):
    """The paired summary of every ordered model pair with the percentile interval of its mean difference."""
    d = stable(differences(spark, sf))
    pair = ["focus", "against"]
    means = R.exact_bootstrap_means(d, pair, "key", ["difference"], EXACT_DRAWS)
    ci = T.percentile_interval(means, pair, ["difference"]).drop("statistic")
    return T.paired_summary(d, pair).join(ci, pair).withColumn(
        "excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    )


@query("sta_2_interval")
def sta_2_interval(spark, sf):
    """Paired summaries with intervals."""
    return sta_2_interval_rows(spark, sf)


def tests(spark, sf):
    """Signed-rank tests of every model pair; the ranking is done once per unordered pair."""
    half = differences(spark, sf).where(F.col("focus") < F.col("against"))
    return T.mirror(T.wilcoxon(half, ["focus", "against"], "difference"))


_WIL = f"""rk AS (SELECT focus, against, difference, rank() OVER w + (count(*) OVER (PARTITION BY focus, against, abs(difference)) - 1) / 2.0 AS r,
count(*) OVER (PARTITION BY focus, against, abs(difference)) AS t FROM df WHERE difference <> 0 WINDOW w AS (PARTITION BY focus, against ORDER BY abs(difference))),
ws AS (SELECT focus, against, count(*) AS n, sum(CASE WHEN difference > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN difference < 0 THEN r ELSE 0 END) AS w_minus,
sum(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY 1, 2),
wz AS (SELECT focus, against, n, least(w_plus, w_minus) AS statistic, (least(w_plus, w_minus) - n * (n + 1.0) / 4) /
sqrt(n * (n + 1.0) * (2.0 * n + 1) / 24 - ties / 48) AS z FROM ws), wp AS (SELECT *, least(1.0, 2.0 * {upper_tail_sql('z')}) AS p FROM wz)"""


@query("sta_3", f"WITH {_DIFF}, {_WIL} SELECT focus, against, n, statistic, z, p FROM wp", "statistic z p")
def sta_3(spark, sf):
    return tests(spark, sf).select("focus", "against", "n", "statistic", "z", "p")


def assay_differences(spark, sf):
    """Two simple predictors of each assay's target, compared row by row."""
    return V.assays(spark, sf).select(
        "assay",
        "vec_id",
        (F.abs(F.col("y") - F.lit(90.0) * F.col("vec")[0]) - F.abs(F.col("y") - F.lit(80.0) * F.col("vec")[1])).alias("d"),
    )


@query(
    "sta_3_exact",
    f"""WITH df AS (SELECT assay, abs(y - 90.0 * vec[1]) - abs(y - 80.0 * vec[2]) AS d FROM v_assay),
    z AS (SELECT assay, d, abs(d) AS a FROM df WHERE d <> 0),
    r AS (SELECT *, rank() OVER (PARTITION BY assay ORDER BY a) + (count(*) OVER (PARTITION BY assay, a) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY assay, a) AS t FROM z),
    w AS (SELECT assay, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS statistic,
    sum(t::DOUBLE * t - 1) AS ties, max(t) AS largest FROM r GROUP BY 1),
    m AS (SELECT max(n) AS n, (max(n) * (max(n) + 1)) // 2 AS top FROM w),
    c AS (WITH RECURSIVE c(k, ways) AS (SELECT 0, list_transform(range(0, top + 1), lambda i: (i = 0)::INT::DOUBLE) FROM m
    UNION ALL SELECT c.k + 1, list_transform(range(0, top + 1), lambda i: c.ways[i + 1] + CASE WHEN i > c.k THEN c.ways[i - c.k] ELSE 0 END) FROM c, m WHERE c.k < m.n) SELECT * FROM c),
    p AS (SELECT w.*, (statistic - n * (n + 1.0) / 4) / sqrt(n * (n + 1.0) * (2.0 * n + 1) / 24 - ties / 48) AS z FROM w)
    SELECT assay, p.n, statistic, least(1.0, 2.0 * {upper_tail_sql('z')}) AS p, CASE WHEN largest > 1 THEN 'tied' WHEN p.n > 200 THEN 'too_large' ELSE 'exact' END AS exact_status,
    CASE WHEN largest = 1 AND p.n <= 200 THEN least(1.0, 2.0 * list_sum(ways[1:floor(statistic)::INT + 1]) / power(2.0, p.n)) END AS p_exact
    FROM p JOIN c ON c.k = p.n""",
    "statistic p p_exact",
)
def sta_3_exact(spark, sf):
    w = T.wilcoxon(assay_differences(spark, sf), ["assay"], "d", None)
    return T.exact_wilcoxon(w).select("assay", "n", "statistic", "p", "exact_status", "p_exact")


_RB = """sl AS (SELECT draw, {h} % total AS slot FROM g, range({d}) AS r(draw)), rs AS (SELECT draw, g.* FROM sl JOIN g ON pos = slot),
rr AS (SELECT draw, {cols} FROM rs), rho AS (SELECT draw, corr(ro, ra) AS a, corr(ro, rn) AS n, corr(ro, rr) AS r FROM rr GROUP BY 1)"""
_RANK = "rank() OVER (PARTITION BY draw ORDER BY {c}) + (count(*) OVER (PARTITION BY draw, {c}) - 1) / 2.0 AS {o}"


@query(
    "sta_4",
    f"""WITH g AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS total FROM v_paired), """
    + _RB.format(
        d=RHO_DRAWS,
        h=_H60.format("draw || '|' || pos"),
        cols=", ".join(_RANK.format(c=c, o=o) for c, o in (("observed", "ro"), ("a", "ra"), ("n", "rn"), ("r", "rr"))),
    )
    + """, d AS (SELECT a - n AS n, a - r AS r FROM rho) SELECT statistic AS against, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high
    FROM (UNPIVOT d ON n, r INTO NAME statistic VALUE v) GROUP BY 1""",
    "ci_low ci_high",
)
def sta_4(spark, sf):
    d = T.bootstrap_rank_differences(V.paired(spark, sf), "key", "observed", "a", ["n", "r"], RHO_DRAWS)
    ci = T.percentile_interval(d.withColumn("scope", F.lit("all")), ["scope"], ["n", "r"])
    return ci.select(F.col("statistic").alias("against"), "ci_low", "ci_high")


_FAMILY = f"""{_DIFF}, {_WIL}, st AS (SELECT *, (count(*) OVER (PARTITION BY focus) - row_number() OVER (PARTITION BY focus ORDER BY p, against) + 1) * p AS step FROM wp),
fam AS (SELECT focus AS family, against, n, statistic, p, least(1.0, max(step) OVER (PARTITION BY focus ORDER BY p, against ROWS UNBOUNDED PRECEDING)) AS p_holm FROM st)"""


def family(spark, sf):
    return S.holm(tests(spark, sf), ["focus"], "p", "against").select(
        F.col("focus").alias("family"), "against", "n", "statistic", "p", "p_holm"
    )


@query("sta_5", f"WITH {_FAMILY} SELECT * FROM fam", "statistic p p_holm")
def sta_5(spark, sf):
    return family(spark, sf)


@query(
    "agg_30",
    f"""WITH {_FAMILY} SELECT family, count(*) AS n_tests, count_if(p < 0.05)::BIGINT AS n_significant,
    count_if(p_holm < 0.05)::BIGINT AS n_after_holm, avg((n > 5000)::INT) AS share_large FROM fam GROUP BY 1""",
    "share_large",
)
def agg_30(spark, sf):
    return family(spark, sf).groupBy("family").agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.count_if(F.col("p") < 0.05).alias("n_significant"),
        F.count_if(F.col("p_holm") < 0.05).alias("n_after_holm"),
        F.avg((F.col("n") > 5000).cast("double")).alias("share_large"),
    )


@query("agg_30_fits")
def agg_30_fits(spark, sf):
    """Per family: groups, share of searches that converged, share with a parameter at a bound, groups without a fit."""
    assays = V.assays(spark, sf)
    found = [
        G.search_groups(assays, "assay", "vec_id", f, 5, V.N_COMPONENTS).withColumn("family", F.lit(f))
        for f in ("additive", "epistatic")
    ]
    # The additive family has no interaction scale that could stand at a bound.
    flagged = G.boundary_hits(found[0].drop("sigma_epi")).unionByName(G.boundary_hits(found[1]), allowMissingColumns=True)
    share = lambda c: F.avg(c.cast("double"))
    return flagged.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_groups"),
        share(F.col("converged")).alias("share_converged"),
        share(F.col("any_hit")).alias("share_at_bound"),
        F.avg("iterations").alias("mean_iterations"),
        F.count_if(F.col("problem").isNotNull()).alias("n_without_fit"),
    )


@query("agg_30_intervals")
def agg_30_intervals(spark, sf):
    """How many of the intervals of a focus model exclude zero, on either side."""
    ci = sta_2_interval_rows(spark, sf)
    return ci.groupBy("focus").agg(
        F.count(F.lit(1)).alias("n_intervals"),
        F.count_if(F.col("ci_low") > 0).alias("n_better"),
        F.count_if(F.col("ci_high") < 0).alias("n_worse"),
    )


@query(
    "sta_6",
    f"""WITH s AS (SELECT 'all' AS scope, * FROM v_pred UNION ALL SELECT 'mutated', * FROM v_pred WHERE mutation_order > 0), r AS ({rho_sql('s', 'model, scope')}),
    c AS (SELECT model, scope, count(*) AS n FROM s GROUP BY 1, 2), z AS (SELECT *, 0.5 * ln((1 + spearman) / (1 - spearman)) * sqrt((n - 3) / 1.06) AS z FROM r JOIN c USING (model, scope))
    SELECT model, scope, n, spearman, z, least(1.0, 2.0 * {upper_tail_sql('z')}) AS p FROM z""",
    "spearman z p",
)
def sta_6(spark, sf):
    scoped = T.with_scopes(
        V.predictions(spark, sf), {"all": F.lit(True), "mutated": F.col("mutation_order") > 0}
    )
    return T.rank_correlation_test(scoped, ["model", "scope"]).select(
        "model", "scope", "n", "spearman", "z", "p"
    )


@query(
    "sta_7",
    f"""WITH a AS (SELECT assay, vec_id, rank() OVER (PARTITION BY assay ORDER BY vec[6]) AS rx, rank() OVER (PARTITION BY assay ORDER BY y) AS ry,
    row_number() OVER (PARTITION BY assay ORDER BY vec_id) AS pos FROM v_assay), o AS (SELECT assay, corr(rx, ry) AS rho, count(*) AS n FROM a GROUP BY 1),
    s AS (SELECT assay, perm, rx, row_number() OVER (PARTITION BY assay, perm ORDER BY {_H.format("perm || '|' || vec_id")}, vec_id) AS pos FROM a, range({PERMS}) AS r(perm)),
    z AS (SELECT s.assay, perm, corr(s.rx, a.ry) AS nul FROM s JOIN a ON s.assay = a.assay AND s.pos = a.pos GROUP BY 1, 2)
    SELECT assay, rho, n, avg((abs(nul) >= abs(rho) - 1e-12)::INT) AS p FROM z JOIN o USING (assay) GROUP BY 1, 2, 3""",
    "rho p",
)
def sta_7(spark, sf):
    rows = V.assays(spark, sf).select("assay", "vec_id", F.col("vec")[5].alias("x"), "y")
    return T.permutation_test_grouped(rows, "assay", "vec_id", "x", "y", PERMS)


_SUB = f"""c AS ({_CORR}), m AS (SELECT assay, vec_id, row_number() OVER (PARTITION BY assay ORDER BY y DESC, vec_id) AS top FROM v_assay),
sub AS (SELECT assay, draw, vec_id FROM m, range({SUBSETS}) AS r(draw) QUALIFY row_number() OVER (PARTITION BY assay, draw ORDER BY {_H.format("draw || '|' || vec_id")}, vec_id) <= 6
UNION ALL SELECT assay, -1, vec_id FROM m WHERE top <= 6), sim AS (SELECT x.assay, x.draw, avg(correlation) AS s FROM sub x JOIN sub y ON x.assay = y.assay AND x.draw = y.draw
AND x.vec_id < y.vec_id JOIN c ON c.assay = x.assay AND c.id_a = x.vec_id AND c.id_b = y.vec_id GROUP BY 1, 2)"""


@query(
    "sta_8",
    f"""WITH {_SUB} SELECT n.assay, o.s AS observed, avg((n.s <= o.s + 1e-12)::INT) AS share_at_or_below FROM sim n JOIN sim o ON n.assay = o.assay
    WHERE n.draw >= 0 AND o.draw = -1 GROUP BY 1, 2""",
    "observed share_at_or_below",
)
def sta_8(spark, sf):
    rows = V.assays(spark, sf)
    return T.subset_share_grouped(rows, correlations(spark, sf), "assay", "vec_id", "correlation", "y", 6, SUBSETS)


@query(
    "sta_9",
    f"""WITH c AS ({_CORR}), t AS (SELECT assay, avg(correlation) AS s FROM (SELECT c.*, v.vec_id AS gone FROM c JOIN v_assay v ON v.assay = c.assay
    AND v.vec_id <> c.id_a AND v.vec_id <> c.id_b) GROUP BY assay, gone) SELECT assay, avg(s) AS mean, min(s) AS low, max(s) AS high, count(*) AS n FROM t GROUP BY 1""",
    "mean low high",
)
def sta_9(spark, sf):
    return T.leave_one_out_similarity(correlations(spark, sf), "assay", "correlation")
