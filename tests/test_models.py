"""Models against plain linear algebra and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewright.functions import gp
from platewright.operators import checks, features as P, folds, gp_models as G, metrics as M, models as L

FIXED = {"lengthscale_multiplier": 1.0, "sigma_main": 1.0, "sigma_epi": 0.5, "sigma_noise": 0.3}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(scale=0.1, size=60) + 5
    return pd.DataFrame({"g": "a", "id": np.arange(60), "vec": x.tolist(), "y": y, "sem": np.where(np.arange(60) % 3 == 0, np.nan, 0.2)})


def frame(spark, rows):
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>, y double, sem double")
    return folds.assign_folds(df.withColumn("sem", F.when(~F.isnan("sem"), F.col("sem"))), "id", 3)


def test_ridge_matches_direct_solution(spark, rows):
    df = frame(spark, rows).withColumn("xy", F.concat("vec", F.array("y")))
    moments = P.complement_second_moments(P.second_moments(df, ["fold"], "xy"), [], "fold")
    got = L.linear_predictions(df, L.ridge(moments, ["fold"], [2.0]), ["fold"], "vec").toPandas()
    x, y = np.vstack(got["vec"]), got["y"].to_numpy()
    for f in range(3):
        tr, te = got["fold"] != f, got["fold"] == f
        mean, sd = x[tr].mean(0), x[tr].std(0)
        z = (x - mean) / sd
        w = np.linalg.solve(z[tr].T @ z[tr] + 2.0 * np.eye(4), z[tr].T @ (y[tr] - y[tr].mean()))
        np.testing.assert_allclose(got["predicted"][te], y[tr].mean() + z[te] @ w, rtol=1e-9)


def test_bayesian_ridge_recovers_signal(spark, rows):
    df = frame(spark, rows).withColumn("xy", F.concat("vec", F.array("y")))
    fit = L.bayesian_ridge(P.second_moments(df.withColumn("all", F.lit(1)), ["all"], "xy"), ["all"]).first()
    np.testing.assert_allclose(fit["coef"], [1.0, -2.0, 0.5, 0.0], atol=0.06)
    assert 40 < fit["noise_precision"] < 250


def test_pca_on_train_rows_only(spark, rows):
    df = frame(spark, rows)
    axes = P.principal_axes(P.complement_second_moments(P.second_moments(df, ["fold"], "vec"), [], "fold"), ["fold"], 2)
    got = axes.where("fold = 1 and component = 0").first()
    pdf = df.toPandas()
    x = np.vstack(pdf.loc[pdf["fold"] != 1, "vec"])
    values = np.linalg.eigvalsh(np.cov(x.T))
    assert abs(got["variance"] - values[-1]) < 1e-9
    moved = df.withColumn("vec", F.when(F.col("fold") == 1, F.transform("vec", lambda v: v + 100)).otherwise(F.col("vec")))
    again = P.principal_axes(P.complement_second_moments(P.second_moments(moved, ["fold"], "vec"), [], "fold"), ["fold"], 2)
    np.testing.assert_allclose(again.where("fold = 1 and component = 0").first()["axis"], got["axis"], atol=1e-9)


def test_neighbours_match_numpy_and_exact_match_wins(spark, rows):
    twin = rows.copy()
    twin.loc[1, "vec"] = None
    twin.at[1, "vec"] = twin.at[0, "vec"]
    df = frame(spark, twin)
    got = L.neighbour_predictions(df, ["g"], "fold", "id", "y", [3], 3, False).toPandas().set_index("id")
    pdf = df.toPandas()
    for r in pdf.itertuples():
        tr = pdf[pdf["fold"] != r.fold]
        sd = np.vstack(tr["vec"]).std(0)
        d = np.sqrt((((np.vstack(tr["vec"]) - np.array(r.vec)) / sd) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:3]
        dn, yn = d[near], tr["y"].to_numpy()[near]
        want = yn[dn == 0].mean() if (dn == 0).any() else (yn / dn).sum() / (1 / dn).sum()
        assert abs(got.loc[r.id, "predicted"] - want) < 1e-9


def test_nested_choice_is_the_inner_minimum(spark, rows):
    df = frame(spark, rows)
    p = L.neighbour_predictions(df, ["g"], "fold", "id", "y", [1, 3, 5], 3, True)
    leaked = p.join(df.select("id", "fold"), "id").where("fold = outer and inner <> outer")
    assert leaked.count() == 0
    out = L.nested_choice(p, ["g"], "id", "k").toPandas()
    assert len(out) == 60
    inner = p.where("inner <> outer").toPandas()
    inner["e"] = (inner["observed"] - inner["predicted"]).abs()
    best = inner.groupby(["outer", "k"])["e"].mean().unstack().min(axis=1)
    np.testing.assert_allclose(out.groupby("outer")["inner_mae"].first(), best)


def test_gp_algebra():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 8))
    y = rng.normal(size=12)
    parts = gp.split_components(x, 4)
    gaps = gp.squared_gaps(parts, parts)
    k = gp.similarity(gaps, gp.median_gap(gaps), 1.0, 0.5)
    np.testing.assert_allclose(np.diag(k), 1.25)
    assert np.linalg.eigvalsh(k).min() > -1e-10
    quiet = gp.Fit(gaps, y, np.zeros(12), {**FIXED, "sigma_noise": 0.0})
    np.testing.assert_allclose(quiet.predict(gaps)[0], y, atol=1e-5)
    fit = gp.Fit(gaps, y, np.full(12, 0.1), FIXED)
    sd = y.std(ddof=1)
    ky = k + np.diag((0.1 / sd) ** 2 + np.full(12, 0.09 + 1e-8))
    want = y.mean() + k @ np.linalg.solve(ky, y - y.mean())
    mean, latent, observed = fit.predict(gaps)
    np.testing.assert_allclose(mean, want, atol=1e-8)
    assert (latent <= observed).all()
    prior = gp.Fit(gaps, y, np.zeros(12), FIXED, score=np.ones(12))
    assert abs(prior.beta[1]) < 1e-9


def test_sem_fill_uses_positive_values():
    np.testing.assert_allclose(gp.fill_sem(np.array([1.0, 3.0, np.nan, 0.0])), [1.0, 3.0, 2.0, 0.0])


def test_scoring_join_equals_dense_prediction(spark, rows):
    df = frame(spark, rows)
    train, test = df.where("fold <> 0"), df.where("fold = 0")
    w = G.fit_groups(train, "g", "id", FIXED, 4)
    joined = G.score_candidates(test, train, w, "g", "id", F.col("lengthscale"), 1.0, 0.5, 4, 1)
    roles = df.withColumn("role", F.when(F.col("fold") == 0, "test").otherwise("train"))
    dense = G.predict_groups(roles, ["g"], "id", [{"name": "f", "family": "epistatic", "params": FIXED}], 4)
    both = joined.join(dense.select("id", F.col("predicted").alias("want"), "sd_latent", "sd_observed"), "id").toPandas()
    np.testing.assert_allclose(both["predicted"], both["want"], atol=1e-9)
    assert (both["sd_latent"] <= both["sd_observed"]).all()


def test_groups_without_a_fit_keep_their_rows(spark, rows):
    few = [{**r, "g": "few", "id": 100 + i} for i, r in enumerate(rows.to_dict("records")[:1])]
    flat = [{**r, "g": "flat", "id": 200 + i, "y": 1.0} for i, r in enumerate(rows.to_dict("records")[:8])]
    df = frame(spark, rows).unionByName(frame(spark, pd.DataFrame(few + flat)))
    w = G.fit_groups(df, "g", "id", FIXED, 4).toPandas()
    assert sorted(w["train_id"]) == sorted([*rows["id"], 100, *range(200, 208)])
    assert w["alpha"].isna().equals(w["problem"].notna())
    named = w.dropna(subset=["problem"]).groupby("g")["problem"].first().to_dict()
    assert named == {"few": "too_few_rows", "flat": "target_does_not_vary"}


def test_fitted_scores_of_rows_without_train_rows(spark, tmp_path):
    """mod_11_gp on four vectors: every test row comes back, with the problem of its assay."""
    from platewright.plans import load

    vectors = spark.range(4).select(
        F.col("id").alias("vec_id"), F.col("id").cast("int").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("float")).alias("embedding")
    )
    vectors.unionByName(vectors.withColumn("vec_id", F.col("vec_id") + 4)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = load()[0]["mod_11_gp"](spark, str(tmp_path)).collect()
    ids = folds.assign_folds(spark.range(8).withColumnRenamed("id", "vec_id"), "vec_id", 5).where("fold = 0")
    assert sorted(r["vec_id"] for r in got) == sorted(r["vec_id"] for r in ids.collect()) and got
    assert {(r["problem"], r["dense_mean"], r["predicted"]) for r in got} == {("too_few_rows", None, None)}


def test_delta_pairs_read_a_written_table(spark):
    """What makes the deltas is not repeated per side of the pairing."""
    wide = spark.range(50).select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("s"), (F.col("id") % 7 * 1.0).alias("d"))
    out = M.pairwise_delta_correlation(wide, "id", "s", "d")
    assert out.inputFiles() and all("/deltas-" in f for f in out.inputFiles())
    r = out.first()
    assert (r["set_a"], r["set_b"], r["n"]) == ("a", "b", 50) and r["correlation"] == pytest.approx(1.0)


def test_comparators_share_one_paired_table(spark, sf, monkeypatch):
    from platewright.plans import load, model_queries as Q

    names, real = [], Q.written
    monkeypatch.setattr(Q, "written", lambda df, name: names.append(name) or real(df, name))
    assert load()[0]["mod_19"](spark, sf).count() == 4 and names == ["paired"]


def test_search_improves_on_the_start(spark, rows):
    df = frame(spark, rows)
    one = G.search_groups(df, "g", "id", "epistatic", 1, 4).first()["objective"]
    many = G.search_groups(df, "g", "id", "epistatic", 5, 4).first()["objective"]
    assert many < one


def test_nested_selection_calibrates_on_inner_rows(spark, rows):
    settings = [{"name": "additive", "family": "additive", "params": FIXED}, {"name": "epistatic", "family": "epistatic", "params": FIXED}]
    p = G.nested_predictions(frame(spark, rows), "g", "fold", "id", settings, 4, 3)
    out = G.nested_selection(p, "g").toPandas()
    assert len(out) == 60 and out["id"].is_unique
    np.testing.assert_allclose(out["sd_calibrated"], out["sd_observed"] * out["scale"])


def test_sigma_scale_and_guard(spark):
    df = spark.createDataFrame([("a", 2.0, 0.0, 1.0), ("a", -2.0, 0.0, 1.0), ("a", 9.0, 0.0, 0.0)], "g string, observed double, predicted double, sd double")
    assert M.sigma_scale(df, ["g"]).first()["scale"] == 2.0
    big = df.select("g", F.lit(1).alias("x"))
    assert checks.large_groups(big, ["g"], 2).count() == 1
    with pytest.raises(checks.CheckFailed):
        checks.fail_fast(checks.large_groups(big, ["g"], 2), "too large")


def test_score_only_metrics_are_null(spark):
    df = spark.createDataFrame([("s", float(i), float(i * i)) for i in range(5)] + [("m", float(i), i + 1.0) for i in range(5)], "model string, observed double, predicted double")
    got = {r["model"]: r for r in M.score_only(M.metric_table(df, ["model"]), F.col("model") == "s").collect()}
    assert got["s"]["mae"] is None and got["s"]["spearman"] == pytest.approx(1.0)
    assert got["m"]["mae"] == pytest.approx(1.0)


def test_constant_side_has_no_rank_correlation(spark):
    df = spark.createDataFrame([("c", float(i), 1.0) for i in range(5)], "model string, observed double, predicted double")
    assert M.rank_correlation(df, ["model"]).first()["spearman"] is None


def test_nested_ridge_against_plain_loops(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.2] + [3, -2, 100]
    y = x @ [1.0, 0.3, -2.0] + rng.normal(size=60)
    fold = np.arange(60) % 3
    rows = spark.createDataFrame(
        [(i, int(fold[i]), x[i].tolist(), float(y[i])) for i in range(60)], "id long, fold int, vec array<double>, y double"
    )
    alphas = [0.1, 10.0, 1000.0]

    def errors(train, test, a):
        m, s = x[train].mean(0), x[train].std(0)
        z = (x[train] - m) / s
        w = np.linalg.solve(z.T @ z + a * np.eye(3), z.T @ (y[train] - y[train].mean()))
        return y[train].mean() + (x[test] - m) / s @ w

    want = {}
    for o in range(3):
        inner = [(np.mean(np.concatenate([
            np.abs(y[fold == i] - errors((fold != o) & (fold != i), fold == i, a)) for i in range(3) if i != o
        ])), a) for a in alphas]
        best = min(inner)[1]
        for i, p in zip(np.flatnonzero(fold == o), errors(fold != o, fold == o, best), strict=True):
            want[int(i)] = (best, p)
    got = {r.id: (r.alpha, r.predicted) for r in L.nested_ridge(rows, "fold", 3, "vec", "y", alphas)[0].collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-8


def _kernel(a, b, params, scale, parts):
    """Similarity of rows by plain loops over components: additive mean plus all ordered pairs."""
    width = a.shape[1] // parts
    ell = params["lengthscale_multiplier"] * scale
    k = [
        np.exp(-0.5 * ((a[:, None, i * width : (i + 1) * width] - b[None, :, i * width : (i + 1) * width]) ** 2).sum(-1) / ell**2)
        for i in range(parts)
    ]
    both = sum(k[i] * k[j] for i in range(parts) for j in range(parts) if i != j)
    return params["sigma_main"] ** 2 * sum(k) / parts + params["sigma_epi"] ** 2 * both / (parts * (parts - 1))


def test_prior_mean_coefficients_belong_to_the_predicting_fit(spark, sf):
    """mod_16 on one assay: generalised least squares with the searched parameters, by explicit inverses."""
    from platewright.plans import load, views as V

    got = load()[0]["mod_16"](spark, sf).toPandas()
    rows = V.assays(spark, sf).toPandas()
    assay = sorted(got["assay"].unique())[0]
    mine = rows[rows["assay"] == assay].sort_values("vec_id")
    out = got[got["assay"] == assay].set_index("vec_id")
    assert set(out.index) == set(mine["vec_id"]) and out["fold"].nunique() > 1
    x = np.vstack(mine["vec"].to_numpy())
    y, sem, fold = mine["y"].to_numpy(), mine["sem"].to_numpy(float), out.loc[mine["vec_id"], "fold"].to_numpy()
    for f in np.unique(fold):
        a, b = fold != f, fold == f
        p = out.loc[mine["vec_id"][b]].iloc[0]
        parts, n = V.N_COMPONENTS, int(a.sum())
        width = x.shape[1] // parts
        gaps = [np.linalg.norm(x[a][i, c * width : (c + 1) * width] - x[a][j, c * width : (c + 1) * width])
                for c in range(parts) for i in range(n) for j in range(i)]
        scale = np.median([g for g in gaps if g > 1e-12])
        centre, spread = y[a].mean(), y[a].std()
        good = sem[a][np.isfinite(sem[a]) & (sem[a] > 0)]
        noise = np.where(np.isfinite(sem[a]), sem[a], np.median(good) if len(good) else 0.0) / spread
        k = _kernel(x[a], x[a], p, scale, parts) + np.diag(noise**2 + p["sigma_noise"] ** 2 + 1e-8)
        s = x[:, 0]
        design = np.column_stack([np.ones(len(s)), (s - s[a].mean()) / s[a].std()])
        inverse = np.linalg.inv(k)
        target = (y[a] - centre) / spread
        beta = np.linalg.solve(design[a].T @ inverse @ design[a] + 1e-8 * np.eye(2), design[a].T @ inverse @ target)
        np.testing.assert_allclose([p["intercept"], p["slope"]], beta, atol=2e-5)
        mean = design[b] @ beta + _kernel(x[b], x[a], p, scale, parts) @ inverse @ (target - design[a] @ beta)
        np.testing.assert_allclose(out.loc[mine["vec_id"][b], "predicted"], centre + spread * mean, rtol=1e-4, atol=1e-4)


def test_deployment_rows(spark, sf):
    """mod_20: the chosen setting has the smallest cross-validated error, parameters are those of all rows, n counts rows."""
    from platewright.plans import load, model_queries as Q, views as V

    got = {r["assay"]: r for r in load()[0]["mod_20"](spark, sf).collect()}
    assays = V.assays(spark, sf)
    n = {r["assay"]: r["count"] for r in assays.groupBy("assay").count().collect()}
    rows = folds.assign_folds(assays, "vec_id", 3)
    cv = G.predict_splits(rows, "assay", "fold", "vec_id", Q.FAMILIES, V.N_COMPONENTS, 3, nested=False).toPandas()
    assert got.keys() == n.keys()
    for assay, r in got.items():
        part = cv[cv["assay"] == assay]
        mae = (part["observed"] - part["predicted"]).abs().groupby(part["setting"]).mean()
        used = part[part["setting"] == r["setting"]]
        assert r["n"] == n[assay] == len(used) and abs(mae[r["setting"]] - mae.min()) < 1e-9
        z = (used["observed"] - used["predicted"]) / used["sd_observed"]
        assert abs(r["scale"] - np.sqrt((z**2).mean())) < 1e-5
    family = {f["name"]: f for f in Q.FAMILIES}
    assay, r = sorted(got.items())[0]
    fit = G.search_groups(assays.where(F.col("assay") == assay), "assay", "vec_id", family[r["setting"]]["family"], 3, V.N_COMPONENTS).first()
    assert all(abs(fit[p] - r[p]) < 1e-5 for p in G.PARAMS)


def test_packed_models_score_any_number_of_candidates(spark):
    rng = np.random.default_rng(9)
    rows = [(g, i, rng.normal(size=8).tolist(), float(rng.normal()), 0.1 if i % 3 else None, "train" if i < 20 else "test")
            for g in "ab" for i in range(60)]
    rows += [("few", i, [0.0] * 8, 1.0, None, "train" if i < 2 else "test") for i in range(4)]
    rows += [("flat", i, rng.normal(size=8).tolist(), 1.0, None, "train" if i < 5 else "test") for i in range(7)]
    rows += [("none", 1, [0.0] * 8, 1.0, None, "test")]
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>, y double, sem double, role string")
    params = {"lengthscale_multiplier": 1.0, "sigma_main": 1.0, "sigma_epi": 0.5, "sigma_noise": 0.3}
    packed = G.pack_models(df.where("role = 'train'"), "g", "id", params, 4)
    assert {r["g"]: r["problem"] for r in packed.collect()} == {"a": None, "b": None, "few": "too_few_rows", "flat": "target_does_not_vary"}
    got = G.score_packed(df.where("role = 'test'"), packed, "g", "id", 4, chunk=7).toPandas()
    assert len(got) == 80 + 2 + 2 + 1
    assert got.groupby("g")["problem"].first().to_dict() == {"a": None, "b": None, "few": "too_few_rows", "flat": "target_does_not_vary", "none": "no_model"}
    settings = [{"name": "s", "family": "epistatic", "params": params}]
    dense = G.predict_groups(df.where("g IN ('a', 'b')"), ["g"], "id", settings, 4).toPandas()
    both = got[got["problem"].isna()].merge(dense, on=["g", "id"], suffixes=("", "_d"))
    assert len(both) == 80
    for c in ("predicted", "sd_latent", "sd_observed"):
        np.testing.assert_allclose(both[c].astype(float), both[c + "_d"], atol=1e-9)
