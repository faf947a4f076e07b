"""Shortlists, floors, diverse panels and controls."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.functions.common import hash32
from platewright.operators.ranking import Order, group_quantiles, keep_first, top_per_group
from platewright.operators.reshape import set_overlap
from platewright.operators.similarity import dense_correlation
from platewright.operators.stability import attach, broadcast_if_small, spread_out, stable

PANEL_LIMIT = 512
JITTER = 1e-9
EIGEN_TOLERANCE = 1e-10


def shortlists(df: DataFrame, groups: list[str], order: Order, sizes: list[int]) -> DataFrame:
    """Top-n lists of several sizes from one ranking pass."""
    top = top_per_group(df, groups, order, max(sizes))
    size = F.explode(F.array(*[F.lit(s).cast("bigint") for s in sorted(sizes)]))
    return top.withColumn("shortlist_size", size).where(F.col("rank") <= F.col("shortlist_size"))


def floor_sensitivity(
    df: DataFrame, groups: list[str], value: str, fractions: list[float]
) -> DataFrame:
    """Floor and eligible count at several fractions of the best value; one pass after the maxima."""
    best = df.groupBy(*groups).agg(F.max(value).alias("_best"))
    counts = (
        attach(df.select(*groups, value), best, groups)
        .groupBy(*groups, "_best")
        .agg(
            *[
                F.count_if(F.col(value) >= F.lit(f) * F.col("_best")).alias(f"_n{i}")
                for i, f in enumerate(fractions)
            ]
        )
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("fraction"),
                (F.lit(f) * F.col("_best")).alias("floor"),
                F.col(f"_n{i}").alias("n_eligible"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    return counts.select(*groups, F.explode(rows).alias("_r")).select(*groups, "_r.*")


def too_few_eligible(df: DataFrame, groups: list[str], eligible: Column, needed: int) -> DataFrame:
    """Groups whose floor leaves fewer rows than the largest shortlist."""
    return (
        df.groupBy(*groups)
        .agg(F.count_if(eligible).alias("n_eligible"))
        .where(F.col("n_eligible") < needed)
    )


def hash_draws(
    shortlist: DataFrame, groups: list[str], key: str, k: int, seeds: list[int]
) -> DataFrame:
    """k members per (group, seed) by hash order: a uniform draw any engine can repeat."""
    rows = shortlist.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    hashed = rows.withColumn("_h", hash32("seed", key))
    return top_per_group(hashed, [*groups, "seed"], [("_h", False), (key, False)], k, "draw_order").drop("_h")


class RankTooLow(ValueError):
    """Fewer independent members than the draw takes."""


class Spectrum:
    """One decomposition of a group's similarity, and the elementary symmetric sums that all its draws share."""

    def __init__(self, correlation: np.ndarray, k: int):
        values, self.vectors = np.linalg.eigh(correlation)
        # The rank is tested on the matrix itself; the jitter only steadies the draws.
        if (values > EIGEN_TOLERANCE * max(1.0, float(values[-1]))).sum() < k:
            raise RankTooLow
        self.values, self.k = np.maximum(values, 0.0) + JITTER, k
        self.sums = _symmetric(self.values, k)

    def draw(self, rng: np.random.Generator) -> list[int]:
        """Exact fixed-size determinantal draw: choose eigenvectors, then project member by member."""
        chosen, left = [], self.k
        for i in reversed(range(len(self.values))):
            if left == 0:
                break
            if rng.random() * self.sums[i + 1, left] < self.values[i] * self.sums[i, left - 1]:
                chosen.append(i)
                left -= 1
        basis = self.vectors[:, chosen]
        residual = (basis**2).sum(axis=1)
        used: list[np.ndarray] = []
        members: list[int] = []
        for _ in range(self.k):
            p = np.maximum(residual, 0.0)
            p[members] = 0.0
            item = int(rng.choice(len(p), p=p / p.sum()))
            direction = basis[item].copy()
            for u in used:
                direction -= (direction @ u) * u
            direction /= np.linalg.norm(direction)
            used.append(direction)
            residual = residual - (basis @ direction) ** 2
            members.append(item)
        return members

    def inclusion(self) -> np.ndarray:
        """Exact probability of every member to be in a draw; they sum to k."""
        whole = self.sums[-1, self.k]
        taken = np.empty(len(self.values))
        for i, v in enumerate(self.values):
            taken[i] = v * _symmetric(np.delete(self.values, i), self.k - 1)[-1, self.k - 1] / whole
        return (self.vectors**2) @ taken


def _symmetric(values: np.ndarray, k: int) -> np.ndarray:
    """Elementary symmetric sums of the first i values, of orders 0 to k."""
    out = np.zeros((len(values) + 1, k + 1))
    out[:, 0] = 1.0
    for i, v in enumerate(values):
        out[i + 1, 1:] = out[i, 1:] + v * out[i, :-1]
    return out


def _spectra(
    pair_table: DataFrame, members: DataFrame, group: str, key: str, value: str, k: int, fields: list, emit
) -> DataFrame:
    """``emit(ids, spectrum, group name)`` rows of every group; one row with its ``problem`` where a draw is impossible.

    Pairs are shuffled once, by group. Problems: too_few_members, rank_below_k, too_many_members.
    """
    everyone = members.select(group, F.col(key).alias("id_a"), F.col(key).alias("id_b"), F.lit(1.0).alias(value))
    cells = pair_table.select(group, "id_a", "id_b", value).unionByName(everyone)
    schema = T.StructType([cells.schema[group], *fields, T.StructField("problem", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf[group].iloc[0]
        ids = np.sort(pdf["id_a"][pdf["id_a"] == pdf["id_b"]].unique())
        problem = "too_few_members" if len(ids) < k else "too_many_members" if len(ids) > PANEL_LIMIT else None
        if problem is None:
            try:
                spectrum = Spectrum(dense_correlation(ids, pdf[pdf["id_a"] != pdf["id_b"]], value), k)
                return pd.DataFrame([(g, *r, None) for r in emit(ids, spectrum, g)], columns=schema.names)
            except RankTooLow:
                problem = "rank_below_k"
        return pd.DataFrame([(g, *[None] * len(fields), problem)], columns=schema.names)

    return spread_out(cells, group).groupBy(group).applyInPandas(run, schema)


def diverse_draws(
    pair_table: DataFrame, members: DataFrame, group: str, key: str, value: str, k: int, seeds: list[int]
) -> DataFrame:
    """k-DPP draws per (group, seed) on bounded shortlists of correlation-normalised similarity.

    All seeds of a group read one decomposition. Returns ``group, seed, key, draw_order, problem``; a group that
    cannot give a draw (fewer than k members, a rank below k, more than PANEL_LIMIT members) has one row with its
    ``problem`` and nothing else.
    """
    fields = [
        T.StructField("seed", T.IntegerType()), T.StructField(key, members.schema[key].dataType),
        T.StructField("draw_order", T.IntegerType()),
    ]

    def emit(ids, spectrum, g):
        for seed in seeds:
            rng = np.random.default_rng([seed, zlib.crc32(str(g).encode())])
            for order, i in enumerate(spectrum.draw(rng)):
                yield seed, ids[i], order + 1

    return _spectra(pair_table, members, group, key, value, k, fields, emit)


def inclusion_probabilities(
    pair_table: DataFrame, members: DataFrame, group: str, key: str, value: str, k: int
) -> DataFrame:
    """``group, key, inclusion, problem``: how often each member belongs to a draw in the long run."""
    fields = [T.StructField(key, members.schema[key].dataType), T.StructField("inclusion", T.DoubleType())]

    def emit(ids, spectrum, g):
        yield from zip(ids, spectrum.inclusion())

    return _spectra(pair_table, members, group, key, value, k, fields, emit)


def pairs_inside(pair_table: DataFrame, panels: DataFrame, group: str, key: str, by: list[str]) -> DataFrame:
    """Pair rows whose both ends belong to the same panel of a group."""
    a = panels.select(group, *by, F.col(key).alias("id_a"))
    b = panels.select(group, *by, F.col(key).alias("id_b"))
    return pair_table.join(a, [group, "id_a"]).join(b, [group, *by, "id_b"])


def farthest_first(
    df: DataFrame,
    groups: list[str],
    key: str,
    value: str,
    k: int,
    similarity: Callable[[Column, Column], Column],
    checkpoint_every: int = 4,
) -> DataFrame:
    """Greedy diverse top-k for groups of any size: start at the best value, then repeatedly take the
    row least similar to the picked ones (ties: higher value, then smaller id).

    Every round is one map plus a partial aggregate; a pick is one row per group.
    """
    state = df.select(*groups, key, value, "vec").withColumn("_near", F.lit(float("-inf")))
    picks = None
    for r in range(1, k + 1):
        order = F.struct(F.col("_near"), -F.col(value), F.col(key))
        chosen = state.groupBy(*groups).agg(
            F.min_by(F.struct(key, value, "vec", F.col("_near").alias("near")), order).alias("_p")
        )
        chosen = stable(chosen.select(*groups, "_p.*"))
        part = chosen.withColumn("pick", F.lit(r))
        picks = part if picks is None else picks.unionByName(part)
        if r < k:
            last = broadcast_if_small(
                chosen.select(*groups, F.col(key).alias("_pk"), F.col("vec").alias("_pv"))
            )
            state = (
                state.join(last, groups)
                .where(F.col(key) != F.col("_pk"))
                .withColumn("_near", F.greatest(F.col("_near"), similarity(F.col("vec"), F.col("_pv"))))
                .drop("_pk", "_pv")
            )
            if r % checkpoint_every == 0:
                state = stable(state)
    return picks.drop("vec")


def panel_diagnostics(
    panels: DataFrame, top_means: DataFrame, groups: list[str], by: list[str], value: str
) -> DataFrame:
    """Value spread, retention against the pure top-k mean, and rank summary of each panel."""
    return (
        panels.groupBy(*groups, *by)
        .agg(
            F.count(F.lit(1)).alias("n_selected"),
            F.avg(value).alias("mean_value"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            F.avg("rank").alias("mean_rank"),
            F.max("rank").alias("worst_rank"),
        )
        .join(top_means, groups)
        .withColumn("retention", F.try_divide("mean_value", "top_mean"))
        .drop("top_mean")
    )


def jaccard_to_primary(draws: DataFrame, primary: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Overlap of every draw with its group's primary panel."""
    flag = primary.select(*groups, key).withColumn("_in", F.lit(1))
    size = primary.groupBy(*groups).agg(F.count(F.lit(1)).alias("_np"))
    joined = draws.join(flag, [*groups, key], "left")
    counts = joined.groupBy(*groups, "seed").agg(
        F.count(F.lit(1)).alias("_nd"), F.coalesce(F.sum("_in"), F.lit(0)).alias("_hit")
    )
    union = F.col("_nd") + F.col("_np") - F.col("_hit")
    return counts.join(size, groups).select(*groups, "seed", (F.col("_hit") / union).alias("jaccard"))


def selection_frequency(
    shortlist: DataFrame, draws: DataFrame, groups: list[str], key: str, n_draws: int
) -> DataFrame:
    """How often each shortlisted candidate was drawn; never-drawn ones stay with zero."""
    counts = draws.groupBy(*groups, key).agg(F.count(F.lit(1)).alias("selection_count"))
    return (
        shortlist.select(*groups, key)
        .join(counts, [*groups, key], "left")
        .na.fill(0, ["selection_count"])
        .withColumn("selection_frequency", F.col("selection_count") / F.lit(float(n_draws)))
    )


def panel_overlap(panels: DataFrame, group: str, by: str, key: str) -> DataFrame:
    """Intersection and Jaccard of panels of different sizes within each group."""
    named = panels.select(
        F.struct(group, by).alias("_set"), F.struct(group, key).alias("_member")
    )
    o = set_overlap(named, "_set", "_member")
    return o.select(
        F.col("set_a")[group].alias(group),
        F.col("set_a")[by].alias("size_a"),
        F.col("set_b")[by].alias("size_b"),
        "intersection",
        "jaccard",
    )


def controls(
    lab: DataFrame, groups: list[str], key: str, value: str, named: Column, n: int
) -> DataFrame:
    """Control cascade without duplicates: named reference, best, nearest to the median, lowest.

    Each list gives its first n rows per group, which is enough: an entry lost to an earlier list is
    already chosen. All ties go to the smaller id.
    """
    med = group_quantiles(lab, groups, value, {"_med": 0.5})
    rows = lab.join(med, groups).withColumn("_gap", F.abs(F.col(value) - F.col("_med")))
    cascade = [
        ("named_reference", rows.where(named), [(key, False)], 1),
        ("highest", rows, [(value, True), (key, False)], 1),
        ("median", rows, [("_gap", False), (key, False)], n),
        ("fallback", rows, [(value, False), (key, False)], n),
    ]
    union = None
    for priority, (reason, source, order, limit) in enumerate(cascade):
        part = (
            top_per_group(source, groups, order, limit, "_within")
            .withColumn("reason", F.lit(reason))
            .withColumn("_priority", F.lit(priority))
        )
        union = part if union is None else union.unionByName(part)
    first = keep_first(union, [*groups, key], [("_priority", False), ("_within", False)])
    return top_per_group(
        first, groups, [("_priority", False), ("_within", False), (key, False)], n
    ).select(*groups, key, value, "reason", "rank")


def append_controls(panel: DataFrame, tail: DataFrame, groups: list[str]) -> DataFrame:
    """Generated panel followed by its controls, ranks continued. Both inputs are ranked panels."""
    sizes = panel.groupBy(*groups).agg(F.max("rank").alias("_n"))
    head = panel.withColumn("panel_rank", F.col("rank")).withColumn("bucket", F.lit("generated"))
    rest = (
        tail.join(sizes, groups, "left")
        .withColumn("panel_rank", F.col("rank") + F.coalesce(F.col("_n"), F.lit(0)))
        .withColumn("bucket", F.lit("control"))
        .drop("_n")
    )
    return head.unionByName(rest, allowMissingColumns=True)


def tested_or_drawn(
    ranking: DataFrame, tested: DataFrame, drawn: DataFrame, group: str, keys: list[str]
) -> DataFrame:
    """Ranking rows of the panel actually tested; groups without one fall back to the drawn panel."""
    hit = ranking.join(tested.select(group, *keys).distinct(), [group, *keys])
    groups_hit = tested.select(group).distinct()
    fallback = drawn.select(group, *keys).distinct().join(groups_hit, group, "left_anti")
    other = ranking.join(fallback, [group, *keys])
    return hit.withColumn("panel", F.lit("tested")).unionByName(other.withColumn("panel", F.lit("drawn")))
