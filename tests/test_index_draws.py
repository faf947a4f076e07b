"""Hash-index resamples of every draw of the reference, against brute force and with bounded work per task."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from platewright.functions.digests import Numbered
from platewright.operators import index_draws as I, stats as T

# ``N_BOOTSTRAP`` of the reference.
REFERENCE_DRAWS = 10_000


def slots(draw: int, n: int) -> list[int]:
    return [int(md5(f"{draw}|{i}".encode()).hexdigest()[:15], 16) % n for i in range(n)]


@pytest.mark.parametrize("name, operator", [("sta_1", "bootstrap_means"), ("sta_4", "bootstrap_rank_differences")])
def test_query_takes_every_draw_of_the_reference(spark, sf, monkeypatch, name, operator):
    asked = []
    run = getattr(T, operator)
    monkeypatch.setattr(T, operator, lambda *a: asked.append(a[-1]) or run(*a[:-1], 3))
    entry.queries()[name](spark, sf)
    assert asked == [REFERENCE_DRAWS]
    assert f"range({REFERENCE_DRAWS})" in entry.oracle_sql()[name]


@pytest.mark.parametrize("low, high", [(0, 10), (95, 100), (9_990, 10_000), (1_234_567, 1_234_577)])
def test_numbered_texts_hash_as_one_by_one(low, high):
    texts = Numbered(low, high)
    for draw in (0, 7, 42, 999, 1234, 56789):
        want = [int(md5(f"{draw}|{i}".encode()).hexdigest()[:15], 16) for i in range(low, high)]
        assert texts.hash60(draw).tolist() == want


def test_picks_of_groups_are_counted(monkeypatch):
    monkeypatch.setattr(I, "SHORT", 200)
    total = np.array([3, 2500, 1, 40])
    first = np.cumsum(total) - total
    counts = I.count_picks([0, 5, 1234], first, total)
    for line, draw in zip(counts, (0, 5, 1234)):
        for f, n in zip(first, total):
            assert line[f : f + n].tolist() == np.bincount(slots(draw, n), minlength=n).tolist()


def test_index_bootstrap_sends_no_picks(spark):
    """Whole draws stay in a task: nothing is shuffled per pick, and a group without a name or a value keeps its place."""
    rows = [(g, i, float(i % 7) if g != "z" else None) for g, n in (("a", 1200), (None, 5), ("z", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(5)
    found = T.bootstrap_means(df, ["g"], "id", ["x"], 12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "MapInArrow" in plan
    got = {(r.g, r.draw): r.x for r in found.where("g is null or g <> 'z'").collect()}
    want = {(g, d): np.mean([s % 7 for s in slots(d, n)]) for g, n in (("a", 1200), (None, 5)) for d in range(12)}
    assert got == pytest.approx(want)
    assert [r.x for r in found.where("g = 'z'").collect()] == [None] * 12
    assert T.bootstrap_means(df.limit(0), ["g"], "id", ["x"], 12).count() == 0


def test_tasks_take_so_many_picks():
    assert I.draw_tasks(60_000, 10_000, 8) == 8
    assert I.draw_tasks(3_600_000, 10_000, 8) == -(-10_000 // 27)
    assert I.draw_tasks(10**9, 10_000, 8) == -(-10_000 // I.MIN_DRAWS)
    assert I.draw_tasks(5, 3, 8) == 3


def brute_differences(rows: pd.DataFrame, draws: int) -> list[tuple]:
    out = []
    for d in range(draws):
        picked = rows.iloc[slots(d, len(rows))]
        rho = {}
        for m in "fpq":
            # Ranks among all picked rows with a value, correlation over rows with both values.
            pair = picked[["t", m]].rank()[picked.t.notna() & picked[m].notna()]
            constant = len(pair) < 2 or pair.t.nunique() < 2 or pair[m].nunique() < 2
            rho[m] = np.nan if constant else np.corrcoef(pair.t, pair[m])[0, 1]
        out.append((d, rho["f"] - rho["p"], rho["f"] - rho["q"]))
    return out


@pytest.mark.parametrize("kind", ["plain", "ties", "missing", "constant"])
@pytest.mark.parametrize("piece", [16, 32768])
def test_rank_differences_of_all_draws(spark, monkeypatch, kind, piece):
    """Against ranking every resample; a tie run longer than a piece is worked on in several."""
    rng = np.random.default_rng(3)
    n = 4 if kind == "constant" else 230
    rows = pd.DataFrame(rng.normal(size=(n, 4)), columns=list("tfpq"))
    rows["f"] += rows.t
    if kind == "ties":
        rows = rows.mul(2).round()
        rows.loc[: n // 2, "q"] = 0.0
    if kind == "missing":
        rows = rows.mask(rng.random(rows.shape) < 0.15)
    want = np.array(brute_differences(rows, 60))
    if kind == "constant":
        assert np.isnan(want).any()
    ranks = (2 * rows.rank()).fillna(0).to_numpy().T.astype(np.int32)
    monkeypatch.setattr(I, "PIECE", piece)
    taken = I.count_picks(list(range(60)), np.zeros(1, np.int64), np.array([n])).T.copy()
    rho = I.Orders(ranks).correlations(taken)
    np.testing.assert_allclose(rho[:, :1] - rho[:, 1:], want[:, 1:], atol=1e-12)
    if piece > n:
        table = spark.createDataFrame([(i * 3, *map(lambda v: None if v != v else float(v), r)) for i, r in enumerate(rows.to_numpy())], "k long, t double, f double, p double, q double")
        found = T.bootstrap_rank_differences(table.repartition(3), "k", "t", "f", ["p", "q"], 60)
        got = found.orderBy("draw").toPandas()
        np.testing.assert_allclose(got.astype(float).to_numpy(), want, atol=1e-12)


def test_rank_differences_rank_the_table_once(spark, monkeypatch):
    """Rows are ranked once, not once per draw: what is sorted does not grow with the draws."""
    seen = []
    ranks = T.average_ranks
    monkeypatch.setattr(T, "average_ranks", lambda df, *a: seen.append(df.count()) or ranks(df, *a))
    df = spark.createDataFrame([(i, float(i % 9), float(i), float(-i), 1.0) for i in range(50)], "k long, t double, f double, p double, q double")
    found = T.bootstrap_rank_differences(df, "k", "t", "f", ["p", "q"], 500)
    assert found.count() == 500 and sum(seen) == 4 * 50
    assert found.where("q is not null").count() == 0
    assert T.bootstrap_rank_differences(df.limit(0), "k", "t", "f", ["p", "q"], 5).count() == 0
