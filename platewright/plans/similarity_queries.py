"""Feature and similarity queries over bounded assays of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions import variants as X
from platewright.functions import vectors as A
from platewright.operators import features as P
from platewright.operators import folds, similarity as S
from platewright.operators.encoding import concatenated_descriptors
from platewright.operators.ranking import group_quantiles
from platewright.operators.stability import scratch_path
from platewright.plans import views as V
from platewright.plans.registry import query

SIGMA_MAIN, SIGMA_EPI = 1.0, 0.5
PARENT = dict(zip(V.POSITIONS, V.PARENT))


def distances(spark, sf):
    return S.with_distances(
        S.pairs(V.assays(spark, sf), ["assay"], "vec_id"), V.N_COMPONENTS, V.COMPONENT_DIM
    )


def pair_kernels(spark, sf):
    d = distances(spark, sf)
    return S.with_kernels(d, S.distance_scale(d, ["assay"]), ["assay"])


def kernels(spark, sf):
    """Long component kernels."""
    k = pair_kernels(spark, sf).select("assay", "id_a", "id_b", "k")
    return S.by_component(k, "k", "_k").withColumnRenamed("_k", "k")


@query(
    "fea_1",
    """SELECT residue, (d0 - avg(d0) OVER ()) / stddev_pop(d0) OVER () AS d0, (d1 - avg(d1) OVER ()) / stddev_pop(d1) OVER () AS d1,
    (d2 - avg(d2) OVER ()) / stddev_pop(d2) OVER () AS d2 FROM v_lookup""",
    "d0 d1 d2",
)
def fea_1(spark, sf):
    return P.standardise_lookup(V.descriptor_lookup(spark, sf), ["d0", "d1", "d2"])


@query(
    "fea_2",
    """WITH s AS (SELECT residue, d0 - 0.001 * d1 + d2 AS v FROM v_lookup) SELECT candidate_id, sum(v) AS feature
    FROM (SELECT candidate_id, unnest(pocket) AS residue FROM v_cand) JOIN s USING (residue) GROUP BY 1""",
    "feature",
)
def fea_2(spark, sf):
    lookup = V.descriptor_lookup(spark, sf).withColumn(
        "v", F.col("d0") - F.lit(0.001) * F.col("d1") + F.col("d2")
    )

    def featurise(keys):
        return concatenated_descriptors(
            keys.withColumn("_p", F.col("pocket")), "pocket", "_p", lookup, ["v"]
        )

    out = P.featurise_distinct(V.candidates(spark, sf), ["pocket"], featurise)
    return out.select("candidate_id", A.total(F.col("vec")).alias("feature"))


@query(
    "fea_3",
    """SELECT vec_id, i - 1 AS dim, vec[i] / greatest(sqrt(list_inner_product(vec, vec)), 1.1920929e-07) AS value
    FROM (SELECT *, unnest(range(1, 65)) AS i FROM v_assay)""",
    "value",
)
def fea_3(spark, sf):
    v = V.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )
    return v.select("vec_id", F.posexplode(A.l2_normalise("vec")).alias("dim", "value"))


@query(
    "fea_4",
    """SELECT vec_id, component, i - 1 AS dim, x[i] AS value FROM (SELECT *, unnest(range(1, 17)) AS i FROM v_comp WHERE component IN (1, 3))""",
    "value",
    "component",
)
def fea_4(spark, sf):
    v = V.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )
    picked = V.components(v, ("vec_id",)).where(F.col("component").isin(1, 3))
    return picked.select("vec_id", "component", F.posexplode("x").alias("dim", "value"))


_REF = """ref AS (SELECT list(m ORDER BY i) AS r FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) AS t(i)
WHERE label = 0 GROUP BY 1))"""


@query(
    "fea_5",
    f"""WITH {_REF} SELECT vec_id, i - 1 AS dim, (vec[i] - r[i]) / sqrt(4.0) AS value
    FROM (SELECT *, unnest(range(1, 65)) AS i FROM v_assay), ref""",
    "value",
)
def fea_5(spark, sf):
    e = V.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )
    ref = P.mean_vector(e.where(F.col("label") == 0), "vec")
    moved = e.withColumn("_ref", ref)
    d = A.delta("vec", "_ref", F.sqrt(F.lit(4.0)))
    return moved.select("vec_id", F.posexplode(d).alias("dim", "value"))


@query(
    "fea_6",
    f"""WITH {_REF} SELECT vec_id, t AS target, i - greatest(1, t - 4) AS dim, (vec[i] - r[i]) / sqrt(least(64, t + 4) - greatest(1, t - 4) + 1.0) AS value
    FROM v_assay, ref, (VALUES (2), (30), (63)) AS w(t), range(1, 65) AS s(i) WHERE i BETWEEN t - 4 AND t + 4""",
    "value",
    "target",
)
def fea_6(spark, sf):
    e = V.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )
    rows = e.withColumn("_ref", P.mean_vector(e.where(F.col("label") == 0), "vec"))
    windows = F.array(
        *[
            F.struct(F.lit(t).alias("target"), A.window_delta("vec", "_ref", t, 4, 64).alias("w"))
            for t in (2, 30, 63)
        ]
    )
    out = rows.select("vec_id", F.explode(windows).alias("_w")).select("vec_id", "_w.*")
    return out.select("vec_id", "target", F.posexplode("w").alias("dim", "value"))


_LOGP = f"""SELECT ([99, 134, 304, 330])[(p_partkey // 20) % 4 + 1] AS pos, substr('{V.ALPHABET}', (p_partkey % 20 + 1)::INT, 1) AS residue,
-sum(p_size)::BIGINT / count(*)::DOUBLE AS logp FROM part GROUP BY 1, 2"""


@query(
    "fea_7",
    f"""WITH p AS ({_LOGP}), m AS (SELECT candidate_id, unnest(list_filter(list_zip([99, 134, 304, 330], ['D', 'F', 'T', 'A'], pocket), lambda z: z[2] <> z[3])) AS z FROM v_cand)
    SELECT candidate_id, coalesce(sum(a.logp - b.logp), 0) AS score FROM v_cand LEFT JOIN m USING (candidate_id)
    LEFT JOIN p a ON a.pos = z[1] AND a.residue = z[3] LEFT JOIN p b ON b.pos = z[1] AND b.residue = z[2] GROUP BY 1""",
    "score",
)
def fea_7(spark, sf):
    part = V.table(spark, sf, "part")
    slot = (F.floor(F.col("p_partkey") / 20) % 4 + 1).cast("int")
    logp = part.groupBy(
        F.element_at(F.array(*[F.lit(p) for p in V.POSITIONS]), slot).alias("pos"),
        F.substring(F.lit(V.ALPHABET), (F.col("p_partkey") % 20 + 1).cast("int"), F.lit(1)).alias("residue"),
    ).agg((-F.sum("p_size") / F.count(F.lit(1))).alias("logp"))
    c = V.candidates(spark, sf)
    muts = c.select("candidate_id", F.explode(X.differences("pocket", PARENT)).alias("m")).select(
        "candidate_id", "m.*"
    )
    scored = P.mutation_scores(muts, "candidate_id", logp)
    return c.select("candidate_id").join(scored, "candidate_id", "left").na.fill(0.0, ["score"])


@query(
    "fea_8",
    """SELECT doc_id, length(text) + 0.5 * (length(text) - length(replace(text, ' ', ''))) AS score FROM documents""",
    "score",
)
def fea_8(spark, sf):
    """Half of the languages are already cached; the rest is scored, appended and joined."""
    key = P.content_key(F.lit("char-score"), F.lit("r1"), F.lit("jvm"), F.col("text"))
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "text", key.alias("content_key"))

    def scorer(rows):
        words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
        return rows.withColumn("score", F.length("text") + F.lit(0.5) * words)

    path = scratch_path(spark, "score-cache")
    known = docs.where(F.col("lang") == "en").dropDuplicates(["content_key"])
    scorer(known).select("content_key", "score").write.parquet(path)
    return P.score_incrementally(docs, "content_key", "text", path, scorer).select("doc_id", "score")


_FOLDS = "(('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % 5)::INT"


@query(
    "fea_9",
    f"""WITH r AS (SELECT l_orderkey, l_quantity AS q, l_discount AS d, {_FOLDS} AS fold FROM lineitem), t AS (SELECT fold, count(*) AS n, sum(q) AS sq,
    sum(q * q) AS qq, sum(d) AS sd, sum(d * d) AS dd FROM r GROUP BY 1), c AS (SELECT fold, sum(n) OVER () - n AS n, sum(sq) OVER () - sq AS sq,
    sum(qq) OVER () - qq AS qq, sum(sd) OVER () - sd AS sd, sum(dd) OVER () - dd AS dd FROM t)
    SELECT l_orderkey, fold, count(*) AS n_rows, sum((q - sq / n) / sqrt(qq / n - (sq / n) ** 2)) AS q_z, sum((d - sd / n) / sqrt(dd / n - (sd / n) ** 2)) AS d_z
    FROM r JOIN c USING (fold) GROUP BY 1, 2""",
    "q_z d_z",
    "fold",
)
def fea_9(spark, sf):
    line = V.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    rows = folds.assign_folds(line, "l_orderkey", 5)
    z = P.scale_on_train(rows, [], "fold", ["l_quantity", "l_discount"])
    return z.groupBy("l_orderkey", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("l_quantity_z").alias("q_z"),
        F.sum("l_discount_z").alias("d_z"),
    )


@query("fea_10")
def fea_10(spark, sf):
    """Train-only PCA per fold from one pass of second moments, projected for held-out rows."""
    e = V.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )
    rows = folds.assign_folds(e, "vec_id", 5)
    per_fold = P.second_moments(rows, ["fold"], "vec")
    axes = P.principal_axes(P.complement_second_moments(per_fold, [], "fold"), ["fold"], 4)
    return P.project(rows, axes, ["fold"], "vec").select(
        "vec_id", "fold", "component", "projection", "variance"
    )


@query(
    "fea_11",
    """SELECT 'embedding' AS source, component, count(DISTINCT vec_id) AS n_keys, max(len(x)) AS dimension FROM v_comp GROUP BY 2""",
    "",
    "component",
)
def fea_11(spark, sf):
    v = V.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )
    store = V.components(v, ("vec_id",)).withColumn("source", F.lit("embedding"))
    return P.catalogue(store, "vec_id")


@query(
    "sim_1",
    "SELECT assay, component, id_a, id_b, d FROM v_dist WHERE d > 1e-12",
    "d",
    "component",
)
def sim_1(spark, sf):
    long = S.by_component(distances(spark, sf), "d", "dist").withColumnRenamed("dist", "d")
    return long.where(F.col("d") > S.IDENTICAL)


@query("sim_2", "SELECT assay, scale FROM v_scale", "scale")
def sim_2(spark, sf):
    return S.distance_scale(distances(spark, sf), ["assay"])


@query("sim_3", "SELECT assay, component, id_a, id_b, k FROM v_kern", "k", "component")
def sim_3(spark, sf):
    return kernels(spark, sf)


@query("sim_4", "SELECT assay, id_a, id_b, avg(k) AS main FROM v_kern GROUP BY 1, 2, 3", "main")
def sim_4(spark, sf):
    return pair_kernels(spark, sf).select("assay", "id_a", "id_b", A.mean_of("k").alias("main"))


@query(
    "sim_5",
    """SELECT assay, a.id_a, a.id_b, avg(a.k * b.k) AS interaction FROM v_kern a JOIN v_kern b USING (assay)
    WHERE a.id_a = b.id_a AND a.id_b = b.id_b AND a.component < b.component GROUP BY 1, 2, 3""",
    "interaction",
)
def sim_5(spark, sf):
    return pair_kernels(spark, sf).select(
        "assay", "id_a", "id_b", A.mean_pair_product("k").alias("interaction")
    )


_TOTAL = f"{SIGMA_MAIN**2} * avg(k) + {SIGMA_EPI**2} * (sum(k) ** 2 - sum(k * k)) / 12.0"


@query(
    "sim_6",
    f"""SELECT assay, id_a, id_b, {_TOTAL} AS similarity FROM v_kern GROUP BY 1, 2, 3 UNION ALL
    SELECT assay, vec_id, vec_id, {SIGMA_MAIN**2 + SIGMA_EPI**2} FROM v_assay""",
    "similarity",
)
def sim_6(spark, sf):
    k = pair_kernels(spark, sf).select(
        "assay", "id_a", "id_b", A.combined("k", SIGMA_MAIN, SIGMA_EPI).alias("similarity")
    )
    diagonal = V.assays(spark, sf).select(
        "assay",
        F.col("vec_id").alias("id_a"),
        F.col("vec_id").alias("id_b"),
        F.lit(SIGMA_MAIN**2 + SIGMA_EPI**2).alias("similarity"),
    )
    return k.unionByName(diagonal)


_DIAG = """SELECT assay, component, count(*) FILTER (d > 1e-12) AS n_nonzero, quantile_cont(d, 0.1) FILTER (d > 1e-12) AS q10,
quantile_cont(d, 0.5) FILTER (d > 1e-12) AS median, quantile_cont(d, 0.9) FILTER (d > 1e-12) AS q90 FROM v_dist GROUP BY 1, 2"""


@query(
    "sim_7",
    f"""WITH q AS ({_DIAG}) SELECT q.*, avg((exp(-0.5 * d * d / (median * median)) < 1e-3)::INT) AS share_near_zero,
    avg((exp(-0.5 * d * d / (median * median)) > 0.9)::INT) AS share_near_one FROM q JOIN v_dist USING (assay, component) GROUP BY ALL""",
    "q10 median q90 share_near_zero share_near_one",
    "component",
)
def sim_7(spark, sf):
    return S.component_diagnostics(distances(spark, sf), ["assay"])


@query(
    "sim_8",
    """WITH r AS (SELECT assay, component, scale, multiplier, CASE WHEN d > 1e-12 THEN exp(-0.5 * d * d / ((multiplier * scale) ** 2)) END AS k
    FROM v_dist JOIN v_scale USING (assay), (VALUES (0.5::DOUBLE), (1.0), (2.0)) AS m(multiplier))
    SELECT assay, component, multiplier, scale, count(*) AS n_pairs, count_if(k IS NULL)::BIGINT AS n_identical,
    count_if(k IS NULL) / count(*)::DOUBLE AS fraction_identical, quantile_cont(k, 0.05) AS q05, quantile_cont(k, 0.25) AS q25,
    quantile_cont(k, 0.5) AS q50, quantile_cont(k, 0.75) AS q75, quantile_cont(k, 0.95) AS q95, avg((k < 1e-3)::INT) AS share_lt_0p001,
    avg((k < 0.01)::INT) AS share_lt_0p01, avg((k > 0.9)::INT) AS share_gt_0p9 FROM r GROUP BY 1, 2, 3, 4""",
    "multiplier scale fraction_identical q05 q25 q50 q75 q95 share_lt_0p001 share_lt_0p01 share_gt_0p9",
    "component",
)
def sim_8(spark, sf):
    d = distances(spark, sf)
    return S.saturation(d.join(S.distance_scale(d, ["assay"]), "assay"), ["assay"], [0.5, 1.0, 2.0])


@query(
    "sim_9",
    f"""WITH k AS (SELECT a.vec_id, CASE b.vec_id WHEN 0 THEN 'first' ELSE 'second' END AS reference,
    exp(-0.5 * list_distance(a.x, b.x) ** 2 / 0.49) AS k FROM v_comp a JOIN v_comp b USING (component) WHERE b.vec_id IN (0, 1))
    SELECT vec_id, reference, ({_TOTAL}) / {SIGMA_MAIN**2 + SIGMA_EPI**2} AS similarity FROM k GROUP BY 1, 2""",
    "similarity",
)
def sim_9(spark, sf):
    v = V.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec")
    )
    return S.to_references(
        v, "vec_id", {0: "first", 1: "second"}, 0.7, V.N_COMPONENTS, V.COMPONENT_DIM, SIGMA_MAIN, SIGMA_EPI
    )


_CORR = """SELECT a.assay, a.vec_id AS id_a, b.vec_id AS id_b, list_inner_product(a.vec, b.vec) /
sqrt(greatest(list_inner_product(a.vec, a.vec), 1e-15) * greatest(list_inner_product(b.vec, b.vec), 1e-15)) AS correlation
FROM v_assay a JOIN v_assay b ON a.assay = b.assay AND a.vec_id < b.vec_id"""


def correlations(spark, sf):
    rows = V.assays(spark, sf)
    p = S.pairs(rows, ["assay"], "vec_id").withColumn("k", A.dot("vec_a", "vec_b")).drop("vec_a", "vec_b")
    return S.correlation_normalise(p, S.self_similarity(rows, ["assay"], "vec_id"), ["assay"], "k", "vec_id")


@query("sim_10", _CORR, "correlation")
def sim_10(spark, sf):
    return correlations(spark, sf).select("assay", "id_a", "id_b", "correlation")


@query(
    "sim_11",
    f"SELECT assay, count(*) AS n_pairs, avg(correlation) AS mean_similarity FROM ({_CORR}) GROUP BY 1",
    "mean_similarity",
)
def sim_11(spark, sf):
    return S.mean_similarity(correlations(spark, sf), ["assay"], "correlation")


@query("sim_11_det")
def sim_11_det(spark, sf):
    """Log-determinant and isometry need a dense matrix per panel."""
    return S.panel_diversity(correlations(spark, sf), "assay", "correlation")


@query(
    "sim_12",
    """WITH z AS (SELECT residue, [(d0 - avg(d0) OVER ()) / stddev_pop(d0) OVER (), (d1 - avg(d1) OVER ()) / stddev_pop(d1) OVER (),
    (d2 - avg(d2) OVER ()) / stddev_pop(d2) OVER ()] AS v FROM v_lookup), p AS (SELECT a.residue AS id_a, b.residue AS id_b, list_distance(a.v, b.v) AS d
    FROM z a JOIN z b ON a.residue < b.residue), s AS (SELECT median(d) AS scale FROM p WHERE d > 1e-12)
    SELECT id_a, id_b, exp(-0.5 * d * d / (scale * scale)) AS similarity FROM p, s""",
    "similarity",
)
def sim_12(spark, sf):
    """The alphabet has twenty letters, so its pairs are a fixed small number."""
    z = P.standardise_lookup(V.descriptor_lookup(spark, sf), ["d0", "d1", "d2"])
    rows = z.select("residue", F.array("d0", "d1", "d2").alias("vec"))
    d = S.with_distances(S.lookup_pairs(rows, "residue"), 1, 3)
    scale = d.agg(F.median(F.when(F.col("d")[0] > S.IDENTICAL, F.col("d")[0]))).scalar()
    return d.select("id_a", "id_b", A.rbf(F.col("d")[0], scale).alias("similarity"))


@query(
    "joi_10",
    "SELECT a.assay, a.vec_id AS id_a, b.vec_id AS id_b FROM v_assay a JOIN v_assay b ON a.assay = b.assay AND a.vec_id < b.vec_id",
)
def joi_10(spark, sf):
    return S.pairs(V.assays(spark, sf), ["assay"], "vec_id").select("assay", "id_a", "id_b")


_VF = "(('0x' || substr(md5({0}vec_id::VARCHAR), 1, 8))::BIGINT % 5)"


@query(
    "joi_11",
    f"""SELECT a.assay, a.vec_id AS test_id, b.vec_id AS train_id, list_distance(a.vec, b.vec) AS d FROM v_assay a JOIN v_assay b USING (assay)
    WHERE {_VF.format('a.')} = 0 AND {_VF.format('b.')} <> 0""",
    "d",
)
def joi_11(spark, sf):
    rows = folds.assign_folds(V.assays(spark, sf), "vec_id", 5)
    p = S.cross_pairs(rows.where(F.col("fold") == 0), rows.where(F.col("fold") != 0), ["assay"], "vec_id")
    return p.select("assay", "test_id", "train_id", A.distance("vec_a", "vec_b").alias("d"))


@query(
    "agg_24",
    f"""WITH q AS ({_DIAG}) SELECT component, count(*) AS n_assays, median(median) AS median_of_medians, avg(n_nonzero) AS mean_pairs FROM q GROUP BY 1""",
    "median_of_medians mean_pairs",
    "component",
)
def agg_24(spark, sf):
    d = S.component_diagnostics(distances(spark, sf), ["assay"])
    flat = d.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_assays"), F.avg("n_nonzero").alias("mean_pairs")
    )
    return flat.join(
        group_quantiles(d, ["component"], "median", {"median_of_medians": 0.5}), "component"
    )
