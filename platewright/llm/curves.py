"""Approximate nearest neighbours by shifted Hilbert curves over random projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.llm.store import saved

# Vectors from which projections' ranges and key bounds are fitted; all vectors are indexed.
SAMPLE = 20_000
# Sampled keys behind each bound, which limits the number of slices of a curve.
KEYS_PER_BOUND = 32


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points ``(n, m)`` with ``bits`` bits per axis (m * bits <= 62).

    Skilling's transform: undo the excess rotations from the top bit down, Gray-encode, interleave.
    """
    x = cells.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> b) & 1)
    return key


class Curves:
    """Random projections with shifts, and the key bounds of each curve's slices."""

    def __init__(self, sample: np.ndarray, radius: float, total: int, curves: int, axes: int, bits: int, slice_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.radius, self.bits = radius, bits
        wide = sample.shape[1] + 1
        axes = min(axes, wide)
        self.planes = np.stack([np.linalg.qr(rng.normal(size=(wide, wide)))[0][:, :axes] for _ in range(curves)])
        lifted = self.lift(sample, False)
        # Each axis spans four deviations to either side of the mean, moved by a part of a deviation.
        seen = np.einsum("nd,cda->cna", lifted, self.planes)
        spread = np.maximum(seen.std(axis=1), 1e-9)
        self.low = seen.mean(axis=1) - 4 * spread + rng.uniform(-0.5, 0.5, size=spread.shape) * spread
        self.scale = (1 << bits) / (8 * spread)
        slices = int(min(max(1, round(total / slice_rows)), max(1, len(sample) // KEYS_PER_BOUND)))
        keys = np.sort(self.keys(lifted), axis=1)
        at = np.linspace(0, keys.shape[1], slices + 1).astype(int)[1:-1]
        self.bounds = keys[:, at]
        self.slices = slices

    def lift(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """One more axis turns the largest inner product into the smallest distance on a sphere."""
        norm = np.sqrt(np.sum(x * x, axis=1))
        if queries:
            return np.column_stack([x * (self.radius / np.maximum(norm, 1e-300))[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.radius**2 - norm**2))])

    def keys(self, lifted: np.ndarray) -> np.ndarray:
        out = []
        for plane, low, scale in zip(self.planes, self.low, self.scale, strict=True):
            cells = np.clip((lifted @ plane - low) * scale, 0, (1 << self.bits) - 1)
            out.append(hilbert_keys(cells.astype(np.int64), self.bits))
        return np.stack(out)

    def places(self, x: np.ndarray, queries: bool) -> tuple[np.ndarray, np.ndarray]:
        """Key and slice per curve and vector, each ``(curves, n)``."""
        keys = self.keys(self.lift(x, queries))
        return keys, np.stack([np.searchsorted(b, k, side="right") for b, k in zip(self.bounds, keys, strict=True)])


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


PLACES = "array<struct<part:int,key:long,q:boolean>>"


def _places(vec: Column, is_query: Column, curves: Curves) -> Column:
    """Every vector once per curve; a query also on its own, in its slice and the two next to it."""

    @F.pandas_udf(PLACES)
    def run(vecs: pd.Series, flags: pd.Series) -> pd.Series:
        x = np.stack(vecs.to_numpy()).astype(np.float64) if len(vecs) else np.empty((0, 1))
        if not len(x):
            return pd.Series([], dtype=object)
        keys, parts = curves.places(x, False)
        q_keys, q_parts = curves.places(x, True)
        n = curves.slices
        out = []
        for i, flag in enumerate(flags):
            rows = [{"part": c * n + int(parts[c, i]), "key": int(keys[c, i]), "q": False} for c in range(len(keys))]
            if flag:
                for c in range(len(keys)):
                    p = int(q_parts[c, i])
                    for near in range(max(0, p - 1), min(n, p + 2)):
                        rows.append({"part": c * n + near, "key": int(q_keys[c, i]), "q": True})
            out.append(rows)
        return pd.Series(out)

    return run(vec, is_query)


FOUND = "q long, found array<struct<cid:long,score:double>>"
FOUND_ARROW = pa.schema([("q", pa.int64()), ("found", pa.list_(pa.struct([("cid", pa.int64()), ("score", pa.float64())])))])


def _scan(dim: int, window: int, keep: int):
    """Rows sorted by (part, key) -> each query's best among the ``window`` vectors to either side.

    Memory holds the open window and one batch, however long a slice is.
    """

    def best(x: np.ndarray, cid: np.ndarray, queries: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names, lists = [], []
        for at, q, v in queries:
            lo, hi = max(0, at - window), at + window
            near, own = x[lo:hi], cid[lo:hi]
            if not len(own):
                continue
            s = near @ v
            top = np.argpartition(-s, keep)[:keep] if len(s) > keep else np.arange(len(s))
            exact = np.sum(near[top] * v, axis=1)
            names.append(q)
            lists.append([{"cid": int(c), "score": float(e)} for c, e in zip(own[top], exact, strict=True)])
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lists, FOUND_ARROW.field("found").type)], schema=FOUND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        x, cid, waiting = np.empty((0, dim)), np.empty(0, np.int64), []
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            flags = batch.column("q").to_numpy(zero_copy_only=False)
            ids = batch.column("cid").to_numpy(zero_copy_only=False)
            vecs = _matrix(batch.column("vec"), dim)
            cuts = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    yield from best(x, cid, waiting)
                    part, x, cid, waiting = parts[lo], x[:0], cid[:0], []
                f = flags[lo:hi]
                before = len(cid) + np.cumsum(~f)
                x = np.concatenate([x, vecs[lo:hi][~f]])
                cid = np.concatenate([cid, ids[lo:hi][~f]])
                for i in np.flatnonzero(f):
                    waiting.append((int(before[i]), int(ids[lo + i]), vecs[lo + i]))
                ready = [w for w in waiting if w[0] + window <= len(cid)]
                yield from best(x, cid, ready)
                waiting = waiting[len(ready):]
                first = min([w[0] for w in waiting], default=len(cid)) - window
                if first > 0:
                    x, cid = x[first:], cid[first:]
                    waiting = [(a - first, q, v) for a, q, v in waiting]
        yield from best(x, cid, waiting)

    return run


def valid(vec: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda v: v != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    k: int = 20,
    curves: int = 20,
    axes: int = 8,
    bits: int = 6,
    window: int = 1024,
    slice_rows: int = 2048,
    sample: int = SAMPLE,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest inner product found for each query row.

    Vectors are ordered along ``curves`` Hilbert curves, each over its own random projection and shift, cut into
    slices by key. In its slice and the next two a query meets the ``window`` vectors on either side; the windows of
    all curves are merged and ranked by the inner product of the original vectors in double precision. The
    index is fitted on a sample of about ``sample`` vectors and holds every vector.

    Equal vectors form one entry with its k + 1 smallest ids, which is all that any answer can show of it, so
    copies neither crowd a window nor cost a row each. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows without id or of another length than the commonest (the longer of
    equally common ones). Ties go to the smaller id; repeated ids count once; fewer candidates give fewer rows;
    an empty table gives none; further columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vec).cast(T.ArrayType(kind)).alias("vec"), is_query.alias("asks")
    ).where(valid(F.col("vec")) & F.col("id").isNotNull())
    # Negative zero and zero are equal; adding zero makes their bytes so.
    rows = rows.withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0).cast(kind)))
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dim = lengths["dim"]
    rows = rows.where(F.size("vec") == dim)
    order = W.partitionBy("vec").orderBy("id")
    few = rows.select("vec", "id").distinct().withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1)
    classes = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = saved(classes.withColumn("cid", F.element_at("ids", 1)), "vectors")
    asking = rows.where("asks").select("id", "vec").distinct().join(classes.select("vec", "cid"), "vec")
    asking = saved(asking.select(F.col("id").alias("query_id"), "cid"), "queries")

    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    total, radius = classes.agg(F.count(F.lit(1)), F.sqrt(F.max(norm))).first()
    unit = F.pmod(F.xxhash64("cid"), F.lit(1 << 24)) / F.lit(float(1 << 24))
    part = classes.where(unit < min(1.0, sample / total)).select("vec").toPandas()["vec"]
    if not len(part):
        part = classes.select("vec").limit(1).toPandas()["vec"]
    fitted = Curves(np.stack(part.to_numpy()).astype(np.float64), radius, total, curves, axes, bits, slice_rows, seed)

    flagged = classes.join(asking.select("cid").distinct().withColumn("asks", F.lit(True)), "cid", "left")
    flagged = flagged.withColumn("asks", F.coalesce("asks", F.lit(False)))
    placed = flagged.select("cid", "vec", F.explode(_places(F.col("vec"), F.col("asks"), fitted)).alias("p"))
    placed = placed.select("p.part", "p.key", "p.q", "cid", "vec")
    found = (
        placed.repartition("part")
        .sortWithinPartitions("part", "key")
        .mapInArrow(_scan(dim, window, k + 1), FOUND)
    )
    merged = found.select("q", F.explode("found").alias("f")).groupBy("q", F.col("f.cid").alias("cid")).agg(
        F.max("f.score").alias("score")
    )
    ranks = W.partitionBy("q").orderBy(F.desc("score"), "cid")
    merged = merged.withColumn("i", F.row_number().over(ranks)).where(F.col("i") <= k + 1).select("q", "cid", "score")
    members = merged.join(classes.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("id"))
    ranks = W.partitionBy("q").orderBy(F.desc("score"), "id")
    members = members.withColumn("i", F.row_number().over(ranks)).where(F.col("i") <= k + 1)
    answers = members.groupBy("q").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "id", "score"))), lambda m: F.struct(m["id"], m["score"])).alias("best")
    )
    own = F.slice(F.filter("best", lambda m: m["id"] != F.col("query_id")), 1, k)
    out = asking.join(answers, F.col("cid") == F.col("q")).select("query_id", F.posexplode(own).alias("pos", "m"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("m.id").alias("vec_id"), F.col("m.score").alias("score"))
