"""Array md5 against hashlib, and the bootstraps that use it against brute force."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pytest

from platewright.functions.digests import md5_words, prefixed_digests
from platewright.operators import stability, stats as T


@pytest.mark.parametrize("length", [0, 1, 3, 4, 31, 52, 55])
def test_md5_of_every_length(length):
    texts = np.random.default_rng(length).integers(0, 256, (40, length), dtype=np.uint8)
    want = [np.frombuffer(md5(t.tobytes()).digest(), ">u4").tolist() for t in texts]
    assert md5_words(texts).T.tolist() == want


def test_prefixed_digests_of_mixed_lengths():
    prefixes, keys = [0, 9, 10, "", "long" * 5], [*range(8, 13), -4, "", "é", "a|b", "x" * 70]
    found = prefixed_digests(prefixes, keys)
    for i, p in enumerate(prefixes):
        for j, k in enumerate(keys):
            assert found[:, i, j].tolist() == np.frombuffer(md5(f"{p}|{k}".encode()).digest(), ">u4").tolist()


def _rows(spark):
    rows = [(g, i, float(i * i % 17) if i % 5 else None, float(i)) for g, n in (("a", 7), ("b", 301)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id long, x double, y double")


def test_index_bootstrap_is_the_hashed_resample(spark, monkeypatch):
    """Same means as slot by slot, over several blocks, without a row per draw and slot."""
    monkeypatch.setattr(T, "BLOCK_PICKS", 1)
    rows, df = _rows(spark)
    found = T.bootstrap_means(df, ["g"], "id", ["x", "y"], 6)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.g, r.draw): (r.x, r.y) for r in found.collect()}
    assert len(got) == 12
    for (g, draw), means in got.items():
        own = [r for r in rows if r[0] == g]
        picks = [own[int(md5(f"{draw}|{s}".encode()).hexdigest()[:15], 16) % len(own)] for s in range(len(own))]
        want = [np.mean([r[c] for r in picks if r[c] is not None]) for c in (2, 3)]
        assert means == pytest.approx(want)


def test_poisson_bootstrap_gets_a_task_per_so_many_hashes(spark, monkeypatch):
    monkeypatch.setattr(T, "TASK_DIGESTS", 20)
    monkeypatch.setattr(T, "HELD_GROUPS", 1)
    tasks = []
    monkeypatch.setattr(T, "spread_rows", lambda *a: tasks.append(stability.spread_rows(*a)) or tasks[-1])
    rows, df = _rows(spark)
    got = {(r.g, r.draw): (r.x, r.y) for r in T.poisson_bootstrap_means(df, ["g"], "id", ["x", "y"], 5).collect()}
    used = [r for r in rows if r[2] is not None]
    assert tasks[0].rdd.getNumPartitions() == -(-len(used) // 10) and len(got) == 10
    limits = [int(t, 16) for t in T.poisson_thresholds()]
    for (g, draw), means in got.items():
        own = [r for r in used if r[0] == g]
        u = [int(md5(f"{draw // 4}|{r[1]}".encode()).hexdigest()[8 * (draw % 4) :][:8], 16) for r in own]
        w = [sum(v >= t for t in limits) for v in u]
        assert means == pytest.approx([np.average([r[c] for r in own], weights=w) for c in (2, 3)])
