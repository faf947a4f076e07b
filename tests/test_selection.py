"""Panels, controls and diversity."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from platewright.functions.vectors import dot
from platewright.operators import selection as L
from platewright.operators import similarity as S


def unit_rows(n, d=6, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_k_dpp_invariants():
    v = unit_rows(12)
    k = v @ v.T * 0.9 + 0.1 * np.eye(12)
    a = L.Spectrum(k, 5).draw(np.random.default_rng(4))
    assert len(set(a)) == 5 and a == L.Spectrum(k, 5).draw(np.random.default_rng(4))


def test_k_dpp_distribution_matches_determinants():
    """Two-member draws from a 3 x 3 kernel occur in proportion to their minors."""
    k = np.array([[1.0, 0.9, 0.1], [0.9, 1.0, 0.2], [0.1, 0.2, 1.0]])
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(4000):
        key = tuple(sorted(L.Spectrum(k, 2).draw(rng)))
        counts[key] = counts.get(key, 0) + 1
    minors = {p: 1 - k[p] ** 2 for p in ((0, 1), (0, 2), (1, 2))}
    total = sum(minors.values())
    for p, m in minors.items():
        assert abs(counts.get(p, 0) / 4000 - m / total) < 0.03


def test_inclusion_probabilities_are_exact():
    """Against all subsets of size k, weighted by their determinants."""
    from itertools import combinations

    v = unit_rows(7)
    matrix = v @ v.T * 0.8 + 0.2 * np.eye(7)
    for k in (1, 3, 6, 7):
        weight = {c: np.linalg.det(matrix[np.ix_(c, c)]) for c in combinations(range(7), k)}
        want = [sum(w for c, w in weight.items() if i in c) / sum(weight.values()) for i in range(7)]
        got = L.Spectrum(matrix, k).inclusion()
        assert np.allclose(got, want, atol=1e-6) and np.isclose(got.sum(), k, atol=1e-6)


def test_frequencies_of_many_seeds_match_the_inclusion_probabilities(spark):
    v = unit_rows(9)
    members = spark.createDataFrame([("g", i) for i in range(9)] + [("few", i) for i in range(2)], "g string, id long")
    pairs = pair_table(spark, v).unionByName(pair_table(spark, unit_rows(2), "few"))
    seeds = list(range(2000))
    draws = L.diverse_draws(pairs, members, "g", "id", "c", 3, seeds).toPandas()
    assert draws[draws["g"] == "few"]["problem"].tolist() == ["too_few_members"]
    mine = draws[draws["g"] == "g"]
    assert (mine.groupby("seed")["id"].nunique() == 3).all() and mine["seed"].nunique() == 2000
    exact = L.inclusion_probabilities(pairs, members, "g", "id", "c", 3).where("g = 'g'").toPandas().set_index("id")["inclusion"]
    shares = mine["id"].value_counts() / 2000
    assert (shares.reindex(exact.index).fillna(0) - exact).abs().max() < 0.04
    few = L.diverse_draws(pairs, members, "g", "id", "c", 3, [5]).where("g = 'g'").toPandas()
    assert few["id"].tolist() == mine[mine["seed"] == 5].sort_values("draw_order")["id"].tolist()


def pair_table(spark, v, group="g"):
    rows = [(group, i, j, float(v[i] @ v[j])) for i in range(len(v)) for j in range(i + 1, len(v))]
    return spark.createDataFrame(rows, "g string, id_a long, id_b long, c double")


def test_diverse_draws_and_rank_problem(spark):
    v = unit_rows(8)
    members = spark.createDataFrame([("g", i) for i in range(8)], "g string, id long")
    ok = L.diverse_draws(pair_table(spark, v), members, "g", "id", "c", 4, [1, 2]).toPandas()
    assert ok.groupby("seed")["id"].nunique().tolist() == [4, 4] and ok["problem"].isna().all()
    flat = np.tile(unit_rows(1), (8, 1))
    bad = L.diverse_draws(pair_table(spark, flat), members, "g", "id", "c", 8, [1]).collect()
    assert [r["problem"] for r in bad] == ["rank_below_k"]
    few = L.diverse_draws(pair_table(spark, v), members, "g", "id", "c", 9, [1]).collect()
    assert [r["problem"] for r in few] == ["too_few_members"]


def test_panel_diversity_bounds(spark):
    v = unit_rows(5)
    r = S.panel_diversity(pair_table(spark, v), "g", "c").first()
    assert r["log_determinant"] <= 0 and 0 < r["isometry"] <= 1 and r["n"] == 5


def test_panels_of_a_group_are_cut_in_one_task(spark):
    """Panels of several sizes per group, one of them singular: the same numbers as panel by panel, one call per group."""
    v, w = unit_rows(6), np.tile(unit_rows(1), (3, 1))
    parts = [pair_table(spark, x).withColumn("seed", F.lit(i)) for i, x in enumerate([v, v[:4], w, v[1:5]])]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    both = every.unionByName(every.withColumn("g", F.lit("h")))
    got = S.panel_diversity(both, "g", "c", by=["seed"]).toPandas().set_index(["g", "seed"]).sort_index()
    assert len(got) == 8
    for i, part in enumerate(parts):
        want = S.panel_diversity(part, "g", "c").toPandas().iloc[0]
        for g in (want["g"], "h"):
            numbers = ["n", "mean_similarity", "log_determinant", "isometry"]
            np.testing.assert_allclose(got.loc[(g, i), numbers].astype(float), want[numbers].astype(float))


def test_farthest_first_matches_brute_force(spark):
    v = unit_rows(40)
    score = np.round(np.random.default_rng(5).random(40), 3)
    pdf = pd.DataFrame({"g": "g", "id": range(40), "s": score, "vec": v.tolist()})
    got = L.farthest_first(spark.createDataFrame(pdf), ["g"], "id", "s", 6, dot).orderBy("pick").toPandas()["id"].tolist()
    want = [int(max(range(40), key=lambda i: (score[i], -i)))]
    while len(want) < 6:
        rest = [i for i in range(40) if i not in want]
        want.append(min(rest, key=lambda i: (max(v[i] @ v[j] for j in want), -score[i], i)))
    assert got == want


def test_control_cascade(spark):
    lab = [("g", "WT", 5.0), ("g", "a", 9.0), ("g", "b", 4.9), ("g", "c", 1.0), ("g", "d", 6.0), ("h", "x", 2.0)]
    df = spark.createDataFrame(lab, "g string, id string, v double")
    got = L.controls(df, ["g"], "id", "v", F.col("id") == "WT", 4).orderBy("g", "rank").collect()
    assert [(r["id"], r["reason"]) for r in got if r["g"] == "g"] == [
        ("WT", "named_reference"), ("a", "highest"), ("b", "median"), ("d", "median"),
    ]
    assert [r["id"] for r in got if r["g"] == "h"] == ["x"]


def test_floor_is_inclusive(spark):
    from platewright.operators.reshape import at_least_fraction_of_best

    df = spark.createDataFrame([("g", 10.0), ("g", 8.0), ("g", 7.9)], "g string, v double")
    assert at_least_fraction_of_best(df, ["g"], "v", 0.8).count() == 2
    assert at_least_fraction_of_best(df, [], "v", 0.8).count() == 2
    got = {r["fraction"]: r["n_eligible"] for r in L.floor_sensitivity(df, ["g"], "v", [0.7, 0.8, 0.9]).collect()}
    assert got == {0.7: 3, 0.8: 2, 0.9: 1}


def test_ranking_keeps_pair_rows_aligned(spark):
    """Sorting candidates by value must not mix up whose similarity is whose."""
    v = unit_rows(6)
    order = [3, 0, 5, 1, 4, 2]
    members = spark.createDataFrame([("g", i) for i in order], "g string, id long")
    panel = members.where(F.col("id").isin(1, 4)).withColumn("seed", F.lit(0))
    inside = L.pairs_inside(pair_table(spark, v), panel, "g", "id", ["seed"]).collect()
    assert len(inside) == 1 and abs(inside[0]["c"] - v[1] @ v[4]) < 1e-12
