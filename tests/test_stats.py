"""Statistics against brute force on small inputs."""

import itertools

import numpy as np
import pandas as pd

from platewright.operators import reshape as S
from platewright.operators import stats as T


def test_exact_signed_rank_matches_enumeration():
    for n in (3, 6, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), bits) if s) for bits in itertools.product([0, 1], repeat=n)]
        for w in range(0, n * (n + 1) // 4):
            want = min(1.0, 2 * np.mean([s <= w for s in sums]))
            assert abs(T._signed_rank_tail(n, w) - want) < 1e-12


def test_wilcoxon_with_ties_and_zeros(spark):
    d = [0.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0, 5.0, 0.0, 6.0]
    df = spark.createDataFrame([("g", float(x)) for x in d] + [("z", 0.0)], "g string, d double")
    got = {r["g"]: r for r in T.wilcoxon(df, ["g"], "d").collect()}
    x = pd.Series([v for v in d if v != 0])
    rank = x.abs().rank()
    minus, plus = rank[x < 0].sum(), rank[x > 0].sum()
    n = len(x)
    ties = x.abs().value_counts()
    var = n * (n + 1) * (2 * n + 1) / 24 - ((ties**3 - ties).sum()) / 48
    z = (min(plus, minus) - n * (n + 1) / 4) / np.sqrt(var)
    assert got["g"]["w_plus"] == plus and got["g"]["w_minus"] == minus
    assert abs(got["g"]["z"] - z) < 1e-12
    from statistics import NormalDist

    assert abs(got["g"]["p"] - 2 * NormalDist().cdf(-abs(z))) < 1e-6
    assert got["z"]["p"] == 1.0 and got["z"]["statistic"] is None
    nan_rule = T.wilcoxon(df, ["g"], "d", None).where("g = 'z'").first()
    assert nan_rule["p"] is None


def test_exact_choice(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, -2, 3, 4, 5)], "g string, d double")
    row = T.exact_wilcoxon(T.wilcoxon(df, ["g"], "d")).first()
    assert row["exact_status"] == "exact" and abs(row["p_exact"] - T._signed_rank_tail(5, 2)) < 1e-12
    tied = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", -2.0)], "g string, d double")
    row = T.exact_wilcoxon(T.wilcoxon(tied, ["g"], "d")).first()
    assert row["exact_status"] == "tied" and row["p_exact"] is None and row["p"] is not None


def test_holm(spark):
    p = [("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.9)]
    got = {r["t"]: r["p_holm"] for r in S.holm(spark.createDataFrame(p, "f string, t string, p double"), ["f"], "p", "t").collect()}
    np.testing.assert_allclose([got[k] for k in "abcd"], [0.04, 0.09, 0.09, 0.9])


def test_bootstrap_shapes(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(50)] + [("h", i, 1.0) for i in range(3)], "g string, k long, v double")
    rows = T.resample_by_index(df, ["g"], "k", ["v"], 20)
    counts = {tuple(r[:2]): r[2] for r in rows.groupBy("g", "draw").count().collect()}
    assert all(counts[("g", d)] == 50 and counts[("h", d)] == 3 for d in range(20))
    ci = T.percentile_interval(T.bootstrap_means(df, ["g"], "k", ["v"], 200), ["g"], ["v"]).collect()
    by = {r["g"]: r for r in ci}
    assert by["h"]["ci_low"] == by["h"]["ci_high"] == 1.0
    assert by["g"]["ci_low"] < 24.5 < by["g"]["ci_high"]
    poisson = T.poisson_bootstrap_means(df, ["g"], "k", ["v"], 200).where("g = 'g'").toPandas()["v"]
    assert abs(poisson.mean() - 24.5) < 1.0 and 1.2 < poisson.std() < 3.0


def test_permutation_and_subsets(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=30)
    df = spark.createDataFrame([("g", i, float(v), float(2 * v)) for i, v in enumerate(x)], "g string, k long, x double, y double")
    row = T.permutation_test(df, ["g"], "k", "x", "y", 60).first()
    assert abs(row["rho"] - 1.0) < 1e-12 and row["p"] == 0.0
    sub = T.random_subsets(df, "g", "k", 5, 10).toPandas()
    assert (sub.groupby("draw")["k"].nunique() == 5).all()


def test_leave_one_out_similarity(spark):
    k = {(0, 1): 0.1, (0, 2): 0.4, (1, 2): 0.7}
    df = spark.createDataFrame([("g", a, b, v) for (a, b), v in k.items()], "g string, id_a long, id_b long, v double")
    r = T.leave_one_out_similarity(df, "g", "v").first()
    assert r["n"] == 3
    np.testing.assert_allclose([r["low"], r["mean"], r["high"]], [0.1, 0.4, 0.7])


def test_grouped_permutations_equal_the_general_form(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(x), float(x + e)) for g in "ab" for i, (x, e) in enumerate(rng.normal(size=(25, 2)))]
    rows += [("c", i, 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, k long, x double, y double")
    fast = {r["g"]: r for r in T.permutation_test_grouped(df, "g", "k", "x", "y", 60).collect()}
    slow = {r["g"]: r for r in T.permutation_test(df, ["g"], "k", "x", "y", 60).collect()}
    for g in "ab":
        assert abs(fast[g]["rho"] - slow[g]["rho"]) < 1e-12 and abs(fast[g]["p"] - slow[g]["p"]) < 1e-12
    assert fast["c"]["rho"] is None and fast["c"]["p"] is None and fast["c"]["n"] == 5


def test_subset_share_against_plain_loops(spark):
    import hashlib

    rng = np.random.default_rng(6)
    c = rng.normal(size=(9, 9))
    members = spark.createDataFrame([("g", i, float(-i)) for i in range(9)] + [("one", 1, 0.0)], "g string, k long, y double")
    pairs = spark.createDataFrame([("g", i, j, float(c[i, j])) for i in range(9) for j in range(i + 1, 9)], "g string, id_a long, id_b long, c double")
    got = {r["g"]: r for r in T.subset_share_grouped(members, pairs, "g", "k", "c", "y", 3, 40).collect()}
    mean = lambda s: np.mean([c[min(a, b), max(a, b)] for a in s for b in s if a < b])
    h = lambda d, k: (hashlib.md5(f"{d}|{k}".encode()).hexdigest()[:8], k)
    draws = [mean(sorted(range(9), key=lambda k: h(d, k))[:3]) for d in range(40)]
    assert abs(got["g"]["observed"] - mean([0, 1, 2])) < 1e-12
    assert abs(got["g"]["share_at_or_below"] - np.mean(np.array(draws) <= mean([0, 1, 2]) + 1e-12)) < 1e-12
    assert got["one"]["observed"] is None
