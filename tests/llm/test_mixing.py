import math
import random
from collections import Counter

import pytest

from platewright.llm import mixing

DOCS = "doc_id long, text string, source string, size string, target string, copy string"


def reshared(sizes: dict) -> dict:
    """Targets as worded: share by weight, stop at twice the size, share the rest again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        level = left / total
        for s in over:
            if level * weight[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
                left -= 2.0 * sizes[s]
        if not open_:
            return target


def _docs(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in (("b", 120), ("a", 15), (None, 30), ("é", 40), ("z", 3), ("", 10), ("empty", 2)):
        for _ in range(n):
            words = 0 if s == "empty" else rng.choice([1, 3, 10, 60, rng.randrange(200)])
            rows.append((len(rows), " ".join("w" * rng.randrange(1, 5) for _ in range(words)), s))
    rows += [(None, "one two", "b"), (5, rows[5][1], "b"), (5, rows[5][1], "b"), (9_000, None, "a")]
    return spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], DOCS), rows


def test_targets_and_taken(spark):
    docs, rows = _docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = reshared(dict(size))
    source = {i: s for i, _, s in rows if i is not None}
    taken, longest = Counter(), Counter()
    for r in got:
        s = source.get(r.doc_id, "b")
        assert r.source_size == size[s] and math.isclose(r.target, want[s], abs_tol=1e-9)
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * longest[s], s
    assert math.isclose(sum(want.values()), 1.5 * sum(size.values()))
    assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(5)).collect(), key=str)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 5}, {"a": 7}, {"a": 0, "b": 0}])
def test_waterfill(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    want = reshared(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_documents_are_repeated_by_their_copies(spark):
    docs, rows = _docs(spark, 2)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.copies
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == ["doc_id", "text", "source", "size", "target", "copy"]
    seen = Counter()
    for r in mixed.collect():
        seen[r.doc_id] += 1
        assert r.copy in (1, 2) and r.size == "mine"
    # Copies are drawn by another key here, so compare by the sum per source.
    source = {i: s for i, _, s in rows if i is not None}
    total = lambda c: Counter({s: sum(n for i, n in c.items() if source.get(i, "b") == s) for s in set(source.values())})
    a, b = total(taken), total(seen)
    assert all(abs(a[s] - b[s]) <= 1 for s in a)


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
