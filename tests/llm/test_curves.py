import numpy as np
import pytest
from pyspark.sql import functions as F

from platewright.llm import curves

VECTORS = "vec_id long, embedding array<float>, score string, rank string"


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (8, 1), (4, 2)])
def test_hilbert_neighbours_touch(axes, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    keys = curves.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(side**axes))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k):
    """Query -> [(id, score)] by all inner products, ties to the smaller id."""
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in ok:
        if q % 20 == 0:
            s = [(-float(np.sum(ok[q] * v)), i) for i, v in ok.items() if i != q]
            out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(130)]
    same = rows[40][1]
    rows += [(i, same) for i in range(200, 260)] + [(300, [-0.0, *same[1:]]), (301, [0.0, *same[1:]])]
    rows += [(400, None), (420, []), (440, [0.0] * 6), (460, [float("nan")] * 6), (480, [None] * 6), (500, [float("inf")] * 6)]
    rows += [(None, same), (0, rows[0][1]), (520, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "mine", "mine") for r in rows], VECTORS)
    got = {}
    for r in curves.nearest(table, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute([r for r in rows if r[0] != 520], 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], "", ""), (20, [1.0, 0.5], "", "")], VECTORS)
    assert sorted((r.query_id, r.vec_id) for r in curves.nearest(one, F.col("vec_id") % 20 == 0).collect()) == [(0, 20), (20, 0)]
    assert curves.nearest(one.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert curves.nearest(one.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_against_all_products(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    # Far smaller windows than the default, which would cover all of so small a table.
    got = curves.nearest(table, F.col("vec_id") % 20 == 0, window=256, slice_rows=512).toPandas()
    hit = total = 0
    for q, found in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:20]]) & set(found["vec_id"]))
        total += 20
    assert total == 20 * (ids % 20 == 0).sum()
    assert hit / total >= 0.9
