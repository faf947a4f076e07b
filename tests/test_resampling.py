import numpy as np
import pytest
from pyspark.sql import functions as F

from platewright.operators import resampling as R
from platewright.operators.stats import percentile_interval


def table(spark, sizes=(("a", 150), ("b", 37), (None, 5), ("one", 1))):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(rng.normal()), float(i % 7)) for g, n in sizes for i in range(n)]
    return spark.createDataFrame([*rows, ("a", 999, None, 1.0), ("gone", 1, 2.0, None)], "g string, id long, x double, y double"), rows


def brute(rows, g, draws, seed, block):
    """Every resample's rows written out, from the same tree."""
    mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
    x = np.array([r[2:] for r in mine])
    tree = R.Tree("\x00" if g is None else g, len(x), draws, seed, block)
    out = np.zeros((draws, 2))
    for k in range(-(-len(x) // block)):
        part = x[k * block : (k + 1) * block]
        taken = tree.block(k)
        index = np.random.default_rng([*tree.key, k, 1 << 31]).integers(0, len(part), taken.sum())
        for d in range(draws):
            at = taken[:d].sum()
            out[d] += part[index[at : at + taken[d]]].sum(axis=0)
    return out / len(x)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 100, 1000])
def test_counts_add_up_to_n_in_every_draw(n):
    tree = R.Tree("g", n, 500, 3, 8)
    blocks = range(-(-n // 8))
    counts = np.array([tree.block(k) for k in blocks])
    assert (counts.sum(axis=0) == n).all() and (counts >= 0).all()
    # Any order of asking gives the same numbers.
    other = R.Tree("g", n, 500, 3, 8)
    other_counts = {}
    for k in [*blocks][::-1]:
        fresh = R.Tree("g", n, 500, 3, 8)
        other_counts[k] = fresh.block(k)
    assert all((other_counts[k] == counts[k]).all() for k in blocks) and other.n == n


def test_counts_are_multinomial():
    tree = R.Tree("g", 64, 20_000, 1, 16)
    counts = np.array([tree.block(k) for k in range(4)])
    assert np.allclose(counts.mean(axis=1), 16, atol=0.15)
    cov = np.cov(counts)
    assert np.allclose(np.diag(cov), 64 * 0.25 * 0.75, rtol=0.05) and np.allclose(cov[0, 1:], -64 / 16, atol=0.4)


@pytest.mark.parametrize("partitions", [1, 7])
def test_means_against_brute_force_for_any_partitioning(spark, partitions):
    df, rows = table(spark)
    got = R.exact_bootstrap_means(df.repartition(partitions), ["g"], "id", ["x", "y"], 40, seed=5, rows=16).toPandas()
    assert set(got["g"]) == {"a", "b", None, "one"} and len(got) == 4 * 40
    for g in ("a", "b", None, "one"):
        mine = got[got["g"].isna() if g is None else got["g"] == g].sort_values("draw")
        assert np.allclose(mine[["x", "y"]], brute(rows, g, 40, 5, 16), atol=1e-9)


def test_a_block_is_added_up_without_a_pass_per_pick(monkeypatch):
    """Sums of a block come from its picks in place: the same numbers, well below the time of weighted counts."""
    from time import process_time

    values, tree = np.random.default_rng(4).normal(size=(1024, 2)), R.Tree("g", 50_000, 4000, 2)
    taken = tree.block(7)
    took = []
    for _ in range(3):
        start = process_time()
        got = tree.sums(7, values)
        took.append(process_time() - start)
    start = process_time()
    picked = values[np.random.default_rng([*tree.key, 7, 1 << 31]).integers(0, 1024, taken.sum())]
    owner = np.repeat(np.arange(4000), taken)
    want = np.column_stack([np.bincount(owner, weights=picked[:, c], minlength=4000) for c in range(2)])
    assert np.allclose(got, want, atol=1e-9) and min(took) < (process_time() - start) / 1.5
    monkeypatch.setattr(R, "AT_ONCE", 100)
    assert np.allclose(tree.sums(7, values), want, atol=1e-9)


def test_interval_is_that_of_a_plain_bootstrap(spark):
    df, rows = table(spark, (("a", 300),))
    means = R.exact_bootstrap_means(df.where("g = 'a'"), [], "id", ["x"], 10_000, rows=32)
    got = percentile_interval(means.withColumn("s", F.lit("all")), ["s"], ["x"]).first()
    x = np.array([r[2] for r in rows])
    plain = x[np.random.default_rng(2).integers(0, 300, (10_000, 300))].mean(axis=1)
    low, high = np.quantile(plain, [0.025, 0.975])
    assert abs(got.ci_low - low) < 0.01 and abs(got.ci_high - high) < 0.01


def test_empty(spark):
    df, _ = table(spark)
    assert R.exact_bootstrap_means(df.limit(0), ["g"], "id", ["x"], 10).count() == 0
