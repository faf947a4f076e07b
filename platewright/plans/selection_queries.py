"""Screening and panel-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions.vectors import dot
from platewright.operators import folds, gp_models as G, selection as L, similarity as S
from platewright.operators.ranking import top_per_group
from platewright.operators.reshape import at_least_fraction_of_best
from platewright.operators.stability import stable
from platewright.plans import views as V
from platewright.plans.model_queries import FIXED
from platewright.plans.registry import query

ORDER = [("p_retailprice", True), ("p_partkey", False)]
SIZES = [20, 25, 30]
_H = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
_RANKED = """rk AS (SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
sl AS (SELECT rk.*, n AS shortlist_size FROM rk, (VALUES (20::BIGINT), (25), (30)) AS s(n) WHERE rank <= n)"""
_PANELS = (
    _RANKED
    + f""", pn AS (SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY p_type, shortlist_size ORDER BY {_H.format("(7 + shortlist_size) || '|' || p_partkey")}, p_partkey) <= 10)"""
)


def parts(spark, sf):
    return V.table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")


def panels(spark, sf):
    """One hash-drawn panel of 10 per type and shortlist size, seeded by the size."""
    from platewright.functions.common import hash32

    lists = L.shortlists(parts(spark, sf), ["p_type"], ORDER, SIZES)
    hashed = lists.withColumn("_h", hash32(F.col("shortlist_size") + 7, "p_partkey"))
    return top_per_group(
        hashed, ["p_type", "shortlist_size"], [("_h", False), ("p_partkey", False)], 10, "draw_order"
    ).drop("_h")


def top_means(spark, sf):
    top = top_per_group(parts(spark, sf), ["p_type"], ORDER, 10)
    return top.groupBy("p_type").agg(F.avg("p_retailprice").alias("top_mean"))


@query(
    "sel_1",
    """WITH b AS (SELECT p_type, max(p_retailprice) AS best FROM part GROUP BY 1) SELECT p_type, f AS fraction, f * any_value(best) AS floor,
    count_if(p_retailprice >= f * best)::BIGINT AS n_eligible FROM part JOIN b USING (p_type), (VALUES (0.7::DOUBLE), (0.8), (0.9)) AS v(f) GROUP BY 1, 2""",
    "fraction floor",
)
def sel_1(spark, sf):
    return L.floor_sensitivity(parts(spark, sf), ["p_type"], "p_retailprice", [0.7, 0.8, 0.9])


@query(
    "sel_2",
    """SELECT p_brand, count_if(p_retailprice >= 0.96 * best)::BIGINT AS n_eligible FROM (SELECT *, max(p_retailprice) OVER () AS best FROM part) GROUP BY 1 HAVING n_eligible < 30""",
)
def sel_2(spark, sf):
    part = V.table(spark, sf, "part").select("p_brand", "p_retailprice")
    best = part.agg(F.max("p_retailprice")).scalar()
    rows = part.withColumn("ok", F.col("p_retailprice") >= F.lit(0.96) * best)
    return L.too_few_eligible(rows, ["p_brand"], F.col("ok"), 30)


def assay_shortlists(spark, sf, size=20):
    """(members, pair correlations) of the best rows of every assay."""
    rows = V.assays(spark, sf)
    members = stable(
        top_per_group(rows, ["assay"], [("y", True), ("vec_id", False)], size).select(
            "assay", "vec_id", "y", "vec", "rank"
        )
    )
    p = S.pairs(members, ["assay"], "vec_id").withColumn("k", dot("vec_a", "vec_b")).drop("vec_a", "vec_b")
    corr = S.correlation_normalise(
        p, S.self_similarity(members, ["assay"], "vec_id"), ["assay"], "k", "vec_id"
    )
    return members.drop("vec"), stable(corr.select("assay", "id_a", "id_b", "correlation"))


SEEDS = list(range(100))


@query("sel_3")
def sel_3(spark, sf):
    members, corr = assay_shortlists(spark, sf)
    return L.diverse_draws(corr, members, "assay", "vec_id", "correlation", 6, SEEDS)


@query("sel_3_inclusion")
def sel_3_inclusion(spark, sf):
    """Exact inclusion probabilities next to the frequencies of the seeded draws."""
    members, corr = assay_shortlists(spark, sf)
    exact = L.inclusion_probabilities(corr, members, "assay", "vec_id", "correlation", 6)
    draws = L.diverse_draws(corr, members, "assay", "vec_id", "correlation", 6, SEEDS).where("problem IS NULL")
    counts = draws.groupBy("assay", "vec_id").agg((F.count(F.lit(1)) / F.lit(float(len(SEEDS)))).alias("frequency"))
    return exact.join(counts, ["assay", "vec_id"], "left").fillna(0.0, ["frequency"])


def _greedy_sql(k: int) -> str:
    steps = [
        "s1 AS (SELECT label, vec_id, v, vec, -1e9::DOUBLE AS near FROM e)",
        "p1 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY v DESC, vec_id) = 1)",
    ]
    for r in range(2, k + 1):
        steps.append(
            f"s{r} AS (SELECT s.label, s.vec_id, s.v, s.vec, greatest(s.near, list_inner_product(s.vec, p.vec)) AS near FROM s{r - 1} s JOIN p{r - 1} p USING (label) WHERE s.vec_id <> p.vec_id)"
        )
        steps.append(
            f"p{r} AS (SELECT * FROM s{r} QUALIFY row_number() OVER (PARTITION BY label ORDER BY near, v DESC, vec_id) = 1)"
        )
    union = " UNION ALL ".join(f"SELECT label, vec_id, v, {r} AS pick FROM p{r}" for r in range(1, k + 1))
    return (
        "WITH e AS (SELECT label, vec_id, embedding[1]::DOUBLE AS v, embedding::DOUBLE[] AS vec FROM embeddings), "
        + ", ".join(steps)
        + f" {union}"
    )


@query("sel_4", _greedy_sql(5), "v", "label pick")
def sel_4(spark, sf):
    """Groups are the unbounded labels: no pair table and no dense matrix is needed."""
    vec = F.col("embedding").cast("array<double>")
    e = V.table(spark, sf, "embeddings").select("label", "vec_id", vec[0].alias("v"), vec.alias("vec"))
    return L.farthest_first(e, ["label"], "vec_id", "v", 5, dot).select("label", "vec_id", "v", "pick")


@query(
    "sel_5",
    f"""WITH {_PANELS}, t AS (SELECT p_type, avg(p_retailprice) AS tm FROM rk WHERE rank <= 10 GROUP BY 1)
    SELECT p_type, shortlist_size, count(*) AS n_selected, avg(p_retailprice) AS mean_value, min(p_retailprice) AS min_value, max(p_retailprice) AS max_value,
    avg(rank) AS mean_rank, max(rank) AS worst_rank, avg(p_retailprice) / any_value(tm) AS retention FROM pn JOIN t USING (p_type) GROUP BY 1, 2""",
    "mean_value min_value max_value mean_rank retention",
)
def sel_5(spark, sf):
    return L.panel_diagnostics(
        panels(spark, sf), top_means(spark, sf), ["p_type"], ["shortlist_size"], "p_retailprice"
    )


@query("sel_6")
def sel_6(spark, sf):
    """Seed sensitivity: overlap with the primary draw and diversity of every draw.

    An assay without draws keeps one row with its ``problem``.
    """
    members, corr = assay_shortlists(spark, sf)
    every = stable(L.diverse_draws(corr, members, "assay", "vec_id", "correlation", 6, SEEDS))
    draws = every.where(F.col("problem").isNull()).select("assay", "seed", "vec_id")
    primary = draws.where(F.col("seed") == 0)
    values = draws.join(members, ["assay", "vec_id"]).groupBy("assay", "seed").agg(
        F.avg("y").alias("mean_value"), F.min("y").alias("min_value")
    )
    inside = L.pairs_inside(corr, draws, "assay", "vec_id", ["seed"])
    diversity = S.panel_diversity(inside, "assay", "correlation", by=["seed"]).drop("n")
    found = values.join(L.jaccard_to_primary(draws, primary, ["assay"], "vec_id"), ["assay", "seed"]).join(
        diversity, ["assay", "seed"]
    )
    failed = every.where(F.col("problem").isNotNull()).select("assay", "problem")
    return found.unionByName(failed, allowMissingColumns=True)


_DRAWN = (
    _RANKED
    + f""", dr AS (SELECT p_type, p_partkey FROM rk, range(100) AS s(seed) WHERE rank <= 25
QUALIFY row_number() OVER (PARTITION BY p_type, seed ORDER BY {_H.format("seed || '|' || p_partkey")}, p_partkey) <= 8)"""
)


@query(
    "sel_7",
    f"""WITH {_DRAWN} SELECT p_type, p_partkey, count(d.k) AS selection_count, count(d.k) / 100.0 AS selection_frequency FROM rk LEFT JOIN
    (SELECT p_type AS t, p_partkey AS k FROM dr) d ON t = p_type AND k = p_partkey WHERE rank <= 25 GROUP BY 1, 2""",
    "selection_frequency",
)
def sel_7(spark, sf):
    short = top_per_group(parts(spark, sf), ["p_type"], ORDER, 25)
    draws = L.hash_draws(short, ["p_type"], "p_partkey", 8, SEEDS)
    return L.selection_frequency(short, draws, ["p_type"], "p_partkey", len(SEEDS))


@query(
    "sel_8",
    f"""WITH {_PANELS} SELECT p_type, a.shortlist_size AS size_a, b.shortlist_size AS size_b, count(*) AS intersection,
    count(*) / (20.0 - count(*)) AS jaccard FROM pn a JOIN pn b USING (p_type, p_partkey) GROUP BY 1, 2, 3""",
    "jaccard",
)
def sel_8(spark, sf):
    return L.panel_overlap(panels(spark, sf), "p_type", "shortlist_size", "p_partkey")


_CTL = """m AS (SELECT p_type, median(p_retailprice) AS med FROM part GROUP BY 1), r AS (SELECT p_type, p_partkey, p_retailprice, abs(p_retailprice - med) AS gap FROM part JOIN m USING (p_type)),
u AS (SELECT *, 0 AS pr, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS w, 'named_reference' AS reason FROM r WHERE p_partkey IN (5, 20, 33, 41) QUALIFY w <= 1
UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS w, 'highest' FROM r QUALIFY w <= 1
UNION ALL SELECT *, 2, row_number() OVER (PARTITION BY p_type ORDER BY gap, p_partkey) AS w, 'median' FROM r
UNION ALL SELECT *, 3, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS w, 'fallback' FROM r),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY p_type, p_partkey ORDER BY pr, w) = 1),
ctl AS (SELECT p_type, p_partkey, p_retailprice, reason, row_number() OVER (PARTITION BY p_type ORDER BY pr, w, p_partkey) AS rank FROM f QUALIFY rank <= 4)"""


def control_rows(spark, sf):
    return L.controls(
        parts(spark, sf), ["p_type"], "p_partkey", "p_retailprice", F.col("p_partkey").isin(5, 20, 33, 41), 4
    )


@query("sel_9", f"WITH {_CTL} SELECT * FROM ctl", "p_retailprice")
def sel_9(spark, sf):
    return control_rows(spark, sf)


@query(
    "sel_10",
    f"""WITH {_RANKED}, {_CTL} SELECT p_type, p_partkey, rank AS panel_rank, 'generated' AS bucket, NULL AS reason FROM rk WHERE rank <= 10
    UNION ALL SELECT p_type, p_partkey, rank + 10, 'control', reason FROM ctl""",
)
def sel_10(spark, sf):
    top = top_per_group(parts(spark, sf), ["p_type"], ORDER, 10)
    out = L.append_controls(top, control_rows(spark, sf), ["p_type"])
    return out.select("p_type", "p_partkey", "panel_rank", "bucket", "reason")


@query(
    "sel_11",
    f"""WITH {_PANELS}, te AS (SELECT DISTINCT p_type, p_partkey FROM part WHERE p_type < 'M' AND p_size = 10), d AS (SELECT DISTINCT p_type, p_partkey FROM pn WHERE p_type NOT IN (SELECT p_type FROM te))
    SELECT p_type, p_partkey, rank, 'tested' AS panel FROM rk JOIN te USING (p_type, p_partkey) UNION ALL
    SELECT p_type, p_partkey, rank, 'drawn' FROM rk JOIN d USING (p_type, p_partkey)""",
)
def sel_11(spark, sf):
    from platewright.operators.ranking import row_positions

    part = V.table(spark, sf, "part")
    tested = part.where((F.col("p_type") < "M") & (F.col("p_size") == 10))
    ranking = row_positions(parts(spark, sf), ["p_type"], ORDER, "rank").drop("total")
    out = L.tested_or_drawn(ranking, tested, panels(spark, sf), "p_type", ["p_partkey"])
    return out.select("p_type", "p_partkey", "rank", "panel")


@query("sel_12")
def sel_12(spark, sf):
    """Ingest, fit, score, floor, rank, shortlist, diverse panel and its diagnostics, per assay."""
    rows = folds.assign_folds(V.assays(spark, sf), "vec_id", 2)
    train, pool = rows.where(F.col("fold") == 0), rows.where(F.col("fold") == 1)
    packed = G.pack_models(train, "assay", "vec_id", FIXED, V.N_COMPONENTS)
    scored = stable(G.score_packed(pool, packed, "assay", "vec_id", V.N_COMPONENTS)).where("problem IS NULL")
    lowest = scored.groupBy("assay").agg(F.min("predicted").alias("low"))
    shifted = stable(
        scored.join(lowest, "assay").select("assay", "vec_id", (F.col("predicted") - F.col("low")).alias("score"))
    )
    eligible = at_least_fraction_of_best(shifted, ["assay"], "score", 0.3)
    short = stable(top_per_group(eligible, ["assay"], [("score", True), ("vec_id", False)], 8))
    vectors = short.join(rows.select("assay", "vec_id", "vec"), ["assay", "vec_id"])
    p = S.pairs(vectors, ["assay"], "vec_id").withColumn("k", dot("vec_a", "vec_b")).drop("vec_a", "vec_b")
    corr = stable(
        S.correlation_normalise(
            p, S.self_similarity(vectors, ["assay"], "vec_id"), ["assay"], "k", "vec_id"
        )
    )
    drawn = L.diverse_draws(corr, short, "assay", "vec_id", "correlation", 4, [20])
    drawn = stable(drawn)
    panel = drawn.where(F.col("problem").isNull()).drop("problem").join(short, ["assay", "vec_id"])
    top = (
        top_per_group(shifted, ["assay"], [("score", True), ("vec_id", False)], 4)
        .groupBy("assay")
        .agg(F.avg("score").alias("top_mean"))
    )
    diag = L.panel_diagnostics(panel, top, ["assay"], [], "score")
    inside = L.pairs_inside(corr, panel, "assay", "vec_id", ["seed"])
    report = diag.join(S.panel_diversity(inside, "assay", "correlation", panels=panel).drop("n"), "assay")
    sure = panel.join(scored, ["assay", "vec_id"]).groupBy("assay").agg(F.avg("sd_observed").alias("panel_sd_observed"))
    report = report.join(sure, "assay")
    status = drawn.groupBy("assay").agg(F.max("problem").alias("problem"))
    return status.join(report, "assay", "left")


