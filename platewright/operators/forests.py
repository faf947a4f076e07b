"""Random forests of all folds and trees grown together: a pass over binned rows per level, whatever the number of folds and trees.

A task adds up weight and target per (fold, tree, node, feature, bin) of its rows; the sums of a tree meet in one task, which
picks the splits of that level. Only chosen splits reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.operators.stability import spread_out, written
from platewright.operators.stats import POISSON_STEPS

BINS = 32
# Values that stand for a feature in one fold when bins are cut, and lists of them that a task holds.
POINTS, LISTS = 1000, 32
# Rows that are added up at once, and bytes of sums that one task holds.
CHUNK_ROWS = 8192
HELD_BYTES = 64 << 20
# A node without children has this split: every bin stays at or below it.
LEAF = 255
POISSON = np.searchsorted(POISSON_STEPS, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


def bag_weights(number: np.ndarray, first: int, trees: int, seed: int) -> np.ndarray:
    """Poisson(1) weights ``(tree, row)``, from a row's number, the tree and the seed alone; four trees share a hash."""
    low, high = first // 4, (first + trees - 1) // 4
    out = []
    for g in range(low, high + 1):
        step = ((seed << 32) + g + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
        z = number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(step)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        out.append(POISSON.take(z.view(np.uint16).reshape(-1, 4)).T)
    return np.concatenate(out)[first - 4 * low :][:trees]


def cuts(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """At most BINS - 1 thresholds: between all neighbours where values are few, else at even shares of the weight."""
    x, at = np.unique(values, return_inverse=True)
    if len(x) <= BINS:
        return (x[1:] + x[:-1]) / 2
    share = np.cumsum(np.bincount(at, weights))
    last = np.unique(np.searchsorted(share, share[-1] * np.arange(1, BINS) / BINS))
    last = last[last < len(x) - 1]
    return (x[last] + x[last + 1]) / 2


class Room:
    """Arrays for some rows on their way through the trees, filled again and again: fresh ones cost more than the sums."""

    def __init__(self, bins: np.ndarray):
        self.bins, self.all = bins.ravel(), [np.empty(len(bins), kind) for kind in ("i8", "i8", "i8", "i8", "u1", "u1", "?")]

    def take(self, rows: np.ndarray, first: int, width: int) -> None:
        """The rows that come next; their bins start at ``first`` of each ``width``."""
        self.base, self.at, self.place, self.cell, self.split, self.found, self.above = (x[: len(rows)] for x in self.all)
        np.multiply(rows, width, out=self.base)
        self.base += first

    def bin(self, feature: np.ndarray) -> np.ndarray:
        """Bins of the rows, of the feature at each row's place in ``feature``."""
        np.take(feature, self.at, out=self.cell, mode="clip")
        self.cell += self.base
        return np.take(self.bins, self.cell, out=self.found, mode="clip")


class Tree:
    """Nodes as arrays. A node leads to ``left``, or the node after it where the bin is above ``split``; a leaf to itself."""

    def __init__(self):
        self.feature, self.left = np.zeros(1, np.intp), np.zeros(1, np.intp)
        self.split, self.value = np.full(1, LEAF, np.uint8), np.zeros(1)
        self.live = np.zeros(1, np.intp)

    def choose(self, features: int, picked: int, rng: np.random.Generator) -> None:
        """The features that each live node may split on; nodes that are done share a place behind the live ones."""
        self.subset = np.zeros((picked, len(self.live) + 1), np.intp)
        self.subset[:, :-1] = rng.random((len(self.live), features)).argsort(axis=1)[:, :picked].T
        self.place = np.full(len(self.value), len(self.live), np.intp)
        self.place[self.live] = np.arange(len(self.live))

    def sums(self) -> np.ndarray:
        """Room for weight and weighted target per feature tried, place and bin."""
        return np.zeros((2, len(self.subset), self.subset.shape[1] * BINS))

    def walk(self, room: Room, steps: int) -> np.ndarray:
        """Nodes of the rows that start at ``room.base``, after some steps."""
        room.at[:] = 0
        for _ in range(steps):
            np.greater(room.bin(self.feature), np.take(self.split, room.at, out=room.split, mode="clip"), out=room.above)
            np.take(self.left, room.at, out=room.place, mode="clip")
            np.add(room.place, room.above, out=room.at)
        return room.at

    def add(self, sums: np.ndarray, room: Room, level: int, w: np.ndarray, wy: np.ndarray) -> None:
        """Weight and weighted target of rows, added per feature, live node and bin."""
        room.at[:] = np.take(self.place, self.walk(room, level), out=room.place, mode="clip")
        room.place *= BINS
        for s, feature in enumerate(self.subset):
            np.add(room.place, room.bin(feature), out=room.cell)
            sums[0, s] += np.bincount(room.cell, w, sums.shape[-1])
            sums[1, s] += np.bincount(room.cell, wy, sums.shape[-1])

    def splits(self, sums: np.ndarray, min_leaf: int) -> dict[str, np.ndarray]:
        """The split of every live node that lessens the squared error most; feature -1 where none does."""
        shape = (2, len(self.subset), len(self.live) + 1, BINS)
        n, s = np.cumsum(sums.reshape(shape)[:, :, :-1].swapaxes(1, 2), axis=-1)
        all_n, all_s = n[..., -1:], s[..., -1:]
        rest_n, rest_s = all_n - n, all_s - s
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((n >= min_leaf) & (rest_n >= min_leaf), s**2 / n + rest_s**2 / rest_n, -np.inf)
            whole = (all_s**2 / all_n)[:, 0, 0]
            mean = (all_s / all_n)[:, 0, 0]
        best = score.reshape(len(score), len(self.subset) * BINS).argmax(axis=1)
        slot, split = np.divmod(best, BINS)
        node = np.arange(len(score))
        pick = lambda x: x[node, slot, split]
        found = pick(score) - whole > 1e-12 * np.abs(pick(score))
        with np.errstate(divide="ignore", invalid="ignore"):
            left, right = pick(s) / pick(n), pick(rest_s) / pick(rest_n)
        feature = np.where(found, self.subset[slot, node], -1)
        names = ("feature", "split", "mean", "n_left", "n_right", "left", "right")
        return dict(zip(names, (feature, split, mean, pick(n), pick(rest_n), left, right), strict=True))

    def grow(self, at: np.ndarray, found: dict[str, np.ndarray], min_leaf: int) -> None:
        """Children for the live nodes that split; those large enough to split again are the next live ones."""
        self.value[self.live[at]] = found["mean"]
        keep = found["feature"] >= 0
        parents, many = self.live[at[keep]], 2 * int(keep.sum())
        new = len(self.value) + np.arange(many)
        both = lambda a, b: np.column_stack([found[a][keep], found[b][keep]]).ravel()
        self.feature[parents], self.split[parents] = found["feature"][keep], found["split"][keep]
        self.left[parents] = new[::2]
        self.feature = np.append(self.feature, np.zeros(many, np.intp))
        self.split = np.append(self.split, np.full(many, LEAF, np.uint8))
        self.left = np.append(self.left, new)
        self.value = np.append(self.value, both("left", "right"))
        self.live = new[both("n_left", "n_right") >= 2 * min_leaf]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """All bytes of a binary column, end to end."""
    parts = []
    for chunk in column.cast(pa.binary()).chunks:
        _, ends, data = chunk.buffers()
        ends = np.frombuffer(ends, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they hold so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _bin(limits, vec: str):
    """Bins of every feature for every fold's forest, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(vec))
            bins = np.empty((len(x), len(limits.value), x.shape[1]), np.uint8)
            for i, forest in enumerate(limits.value):
                for j, c in enumerate(forest):
                    bins[:, i, j] = np.searchsorted(c, x[:, j])
            ends = np.arange(len(x) + 1, dtype=np.int32) * (bins.size // max(1, len(x)))
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            names = ["_number", "_fold", "_y"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), packed], [*names, "_bins"])

    return run


SUMS = "forest int, tree int, part int, sums binary"
CHOSEN = "forest int, tree int, place int, feature int, split int, mean double, n_left double, n_right double, left double, right double"


def _add_up(model, folds: list[int], first: int, level: int, seed: int, bootstrap: bool):
    """Sums of a task's rows for some trees of every fold's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = model.value
        sums = [[tree.sums() for tree in trees] for trees in forests]
        many, most = len(forests[0]), max(x[0].size for trees in sums for x in trees)
        seen = False
        for rows in _chunks(batches, max(CHUNK_ROWS, most)):
            seen = True
            fold, y, number = (rows.column(c).to_numpy() for c in ("_fold", "_y", "_number"))
            room = Room(_bytes(rows.column("_bins")).reshape(len(fold), -1))
            width = room.bins.size // len(fold)
            drawn = bag_weights(number, first, many, seed) if bootstrap else np.ones((many, len(fold)), np.uint8)
            learnt = [fold != f for f in folds]
            for t in range(many):
                w, some = drawn[t].astype(float), drawn[t] > 0
                wy = w * y
                for i, trees in enumerate(forests):
                    picked = np.flatnonzero(some & learnt[i])
                    room.take(picked, i * (width // len(folds)), width)
                    trees[t].add(sums[i][t], room, level, w.take(picked), wy.take(picked))
        if seen:
            part = TaskContext.get().partitionId()
            for i, trees in enumerate(sums):
                blobs = pa.array([x.tobytes() for x in trees], pa.binary())
                ids = ([i] * many, range(first, first + many), [part] * many)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in ids), blobs], ["forest", "tree", "part", "sums"])

    return run


def _choose(model, first: int, min_leaf: int):
    """Splits of one tree's live nodes from the sums of all tasks, added in the order of the tasks."""

    def run(parts: pa.Table) -> pa.Table:
        forest, number = parts.column("forest")[0].as_py(), parts.column("tree")[0].as_py()
        tree = model.value[forest][number - first]
        total = tree.sums()
        blobs = parts.column("sums")
        for k in np.argsort(parts.column("part").to_numpy()):
            total += np.frombuffer(blobs[int(k)].as_buffer()).reshape(total.shape)
        found = tree.splits(total, min_leaf)
        n = len(tree.live)
        ids = {"forest": np.full(n, forest), "tree": np.full(n, number), "place": np.arange(n)}
        kinds = {k: pa.int32() for k in (*ids, "feature", "split")}
        both = ids | found
        return pa.table({k: pa.array(v, kinds.get(k, pa.float64())) for k, v in both.items()})

    return run


def _predict(model, limits, folds: list[int], vec: str, fold: str, steps: int, centre: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column(vec)), batch.column(fold).to_numpy(zero_copy_only=False)
            predicted = np.zeros(len(x))
            for f, forest, c in zip(folds, model.value, limits.value, strict=True):
                mine = np.flatnonzero(at == f)
                bins = np.empty((len(mine), x.shape[1]), np.uint8)
                for j, limit in enumerate(c):
                    bins[:, j] = np.searchsorted(limit, x[mine, j])
                room = Room(bins)
                room.take(np.arange(len(mine)), 0, x.shape[1])
                found = sum(tree.value.take(tree.walk(room, steps)) for tree in forest)
                predicted[mine] = centre + found / len(forest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted)], [*batch.schema.names, "predicted"])

    return run


def condensed(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values with their weights, or where these are more than POINTS, as many quantiles of equal weight."""
    if weights is None:
        x, w = np.unique(values, return_counts=True)
        w = w.astype(float)
    else:
        x, at = np.unique(values, return_inverse=True)
        w = np.bincount(at, weights)
    if len(x) <= POINTS:
        return x, w
    share = np.cumsum(w)
    at = np.searchsorted(share, share[-1] * (np.arange(POINTS) + 0.5) / POINTS)
    return x[at], np.full(POINTS, share[-1] / POINTS)


def _merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return condensed(*(np.concatenate(x) for x in zip(*lists, strict=True)))


VALUES = "fold int, feature int, part int, value array<double>, weight array<double>"


def _values(vec: str):
    """Condensed values of every feature per fold of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x, fold = _matrix(batch.column(vec)), batch.column("_fold").to_numpy()
            for f in np.unique(fold).tolist():
                mine = x[fold == f]
                for j in range(x.shape[1]):
                    lists = held.setdefault((f, j), [])
                    lists.append(condensed(mine[:, j]))
                    if len(lists) > LISTS:
                        lists[:] = [_merged(lists)]
        part = TaskContext.get().partitionId()
        for (f, j), lists in held.items():
            value, weight = _merged(lists)
            yield pa.RecordBatch.from_pydict(
                {"fold": pa.array([f], pa.int32()), "feature": pa.array([j], pa.int32()), "part": pa.array([part], pa.int32()),
                 "value": [value], "weight": [weight]}
            )

    return run


def _merge_values(parts: pa.Table) -> pa.Table:
    parts = parts.sort_by("part")
    columns = [[np.asarray(x) for x in parts.column(c).to_pylist()] for c in ("value", "weight")]
    value, weight = _merged(list(zip(*columns, strict=True)))
    return parts.slice(0, 1).drop_columns(["value", "weight"]).append_column("value", [[value]]).append_column("weight", [[weight]])


def _counted(rows: DataFrame, vec: str, features: int) -> tuple[dict[int, int], float]:
    """Rows per fold and the mean target; refuses what is no number."""
    bad = F.col("_y").isNull() | F.isnan("_y") | F.exists(vec, lambda v: v.isNull() | F.isnan(v)) | (F.size(vec) != features)
    found = rows.groupBy("_fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad")
    ).collect()
    if any(r["bad"] for r in found):
        raise ValueError("targets and features of a forest must be numbers, the same number of features in every row")
    counts = {r["_fold"]: r["n"] for r in found}
    return counts, sum(r["y"] for r in found) / sum(counts.values())


def forest_cv(
    df: DataFrame,
    key: str,
    vec: str,
    y: str,
    fold: str,
    k: int,
    trees: int = 500,
    min_leaf: int = 2,
    seed: int = 42,
    depth: int = 8,
    bootstrap: bool = True,
) -> DataFrame:
    """Random forest per fold, learnt from the rows of the other folds; adds ``predicted``.

    A third of the features is tried at each split (all of them by a single tree), at most 32 bins of each, cut at
    quantiles of the fold's training rows. All folds and trees share a pass per level; where their sums exceed
    ``HELD_BYTES`` a task, trees take turns. Rows without a fold take no part.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    kept = written(spread_out(df.where(F.col(fold).isNotNull()), key), "forest-rows")
    one = kept.select(vec).first()
    if one is None:
        return kept.withColumn("predicted", F.lit(None).cast("double"))
    features = len(one[0])
    rows = kept.withColumn("_fold", F.col(fold).cast("int")).withColumn("_y", F.col(y).cast("double"))
    counts, centre = _counted(rows, vec, features)
    folds = [f for f in sorted(counts) if 0 <= f < k]
    if len(counts) < 2 and folds:
        raise ValueError("a forest needs rows outside the fold it predicts")
    values = rows.mapInArrow(_values(vec), VALUES).groupBy("fold", "feature").applyInArrow(_merge_values, VALUES).toPandas()
    lists = {(f, j): (x, w) for f, j, x, w in values[["fold", "feature", "value", "weight"]].itertuples(index=False)}
    limits = sc.broadcast(
        [[cuts(*_merged([lists[g, j] for g in sorted(counts) if g != f])) for j in range(features)] for f in folds]
    )

    numbered = rows.select(
        F.monotonically_increasing_id().alias("_number"), "_fold", (F.col("_y") - F.lit(centre)).alias("_y"), vec
    )
    binned = written(numbered.mapInArrow(_bin(limits, vec), "_number long, _fold int, _y double, _bins binary"), "forest-bins")

    forests = [[Tree() for _ in range(trees)] for _ in folds]
    picked = features if trees == 1 else -(-features // 3)
    for level in range(depth):
        for i, forest in enumerate(forests):
            for t, tree in enumerate(forest):
                tree.choose(features, picked, np.random.default_rng([seed, folds[i], t, level]))
        size = sum(max(tree.sums().nbytes for tree in forest) for forest in forests)
        turn = max(1, HELD_BYTES // max(1, size))
        for first in range(0, trees, turn):
            some = [forest[first : first + turn] for forest in forests]
            if not any(len(tree.live) for forest in some for tree in forest):
                continue
            model = sc.broadcast(some)
            sums = binned.mapInArrow(_add_up(model, folds, first, level, seed, bootstrap), SUMS)
            chosen = sums.groupBy("forest", "tree").applyInArrow(_choose(model, first, min_leaf), CHOSEN).toPandas()
            for (i, t), found in chosen.groupby(["forest", "tree"]):
                columns = {c: found[c].to_numpy() for c in found.columns}
                forests[i][t].grow(columns["place"], columns, min_leaf)
            model.unpersist()

    model = sc.broadcast(forests)
    schema = T.StructType([*kept.schema.fields, T.StructField("predicted", T.DoubleType())])
    predicted = kept.where(F.col(fold).isin(folds))
    return predicted.mapInArrow(_predict(model, limits, folds, vec, fold, depth, centre), schema)
