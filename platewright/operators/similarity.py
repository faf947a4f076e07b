"""Pair tables inside bounded groups and the similarities built on them.

All pairs are formed only inside a declared group of bounded size (an assay or a panel, see
``ranking.hash_blocks``), so the pair count is linear in the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions.vectors import combined, component_distances, dot, rbf
from platewright.operators.stability import spread_out

IDENTICAL = 1e-12


def pairs(df: DataFrame, groups: list[str], key: str, vec: str = "vec") -> DataFrame:
    """Unordered pairs (id_a < id_b) of a group with both vectors."""
    rows = spread_out(df.select(*groups, key, vec), *groups)
    a = rows.select(*groups, F.col(key).alias("id_a"), F.col(vec).alias("vec_a"))
    b = rows.select(*groups, F.col(key).alias("id_b"), F.col(vec).alias("vec_b"))
    return a.join(b, groups).where(F.col("id_a") < F.col("id_b"))


def lookup_pairs(lookup: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Pairs of a lookup with one row per letter: the whole alphabet travels as one array value."""
    letters = lookup.agg(
        F.collect_list(F.struct(F.col(key).alias("id_b"), F.col(vec).alias("vec_b")))
    ).scalar()
    rows = lookup.select(F.col(key).alias("id_a"), F.col(vec).alias("vec_a"), letters.alias("_all"))
    later = F.explode(F.filter("_all", lambda x: x["id_b"] > F.col("id_a")))
    return rows.select("id_a", "vec_a", later.alias("_b")).select("id_a", "vec_a", "_b.*")


def cross_pairs(test: DataFrame, train: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Every test row with every train row of its group."""
    a = test.select(*groups, F.col(key).alias("test_id"), F.col("vec").alias("vec_a"))
    b = train.select(*groups, F.col(key).alias("train_id"), F.col("vec").alias("vec_b"))
    return a.join(b, groups)


def with_distances(pair_table: DataFrame, n: int, width: int) -> DataFrame:
    """Per-component distances as one array; the vectors are dropped."""
    return pair_table.withColumn(
        "d", component_distances("vec_a", "vec_b", n, width)
    ).drop("vec_a", "vec_b")


def by_component(pair_table: DataFrame, column: str, out: str) -> DataFrame:
    keep = [c for c in pair_table.columns if c != column]
    return pair_table.select(*keep, F.posexplode(column).alias("component", out))


def distance_scale(pair_table: DataFrame, groups: list[str]) -> DataFrame:
    """Median non-zero distance pooled over the components of a bounded group."""
    long = by_component(pair_table, "d", "_d")
    return (
        long.where((F.col("_d") > IDENTICAL) & (F.col("_d") != F.lit(float("inf"))))
        .groupBy(*groups)
        .agg(F.median("_d").alias("scale"))
    )


def with_kernels(
    pair_table: DataFrame, scales: DataFrame, groups: list[str], multiplier: float = 1.0
) -> DataFrame:
    """RBF similarity per component with the length scale of the group."""
    ell = F.lit(multiplier) * F.col("scale")
    return pair_table.join(scales, groups).withColumn("k", F.transform("d", lambda d: rbf(d, ell)))


def component_diagnostics(pair_table: DataFrame, groups: list[str]) -> DataFrame:
    """Distance quantiles and kernel saturation per component, scaled by its own median."""
    long = by_component(pair_table, "d", "_d").where(F.col("_d").isNotNull())
    keys = [*groups, "component"]
    usable = F.when(F.col("_d") > IDENTICAL, F.col("_d"))
    q = F.percentile(usable, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    flat = long.groupBy(*keys).agg(F.count(usable).alias("n_nonzero"), q.alias("_q"))
    k = rbf(F.col("_d"), F.col("_q")[1])
    return (
        long.join(flat, keys)
        .groupBy(*keys, "n_nonzero", "_q")
        .agg(
            F.avg((k < 1e-3).cast("double")).alias("share_near_zero"),
            F.avg((k > 0.9).cast("double")).alias("share_near_one"),
        )
        .select(
            *keys,
            "n_nonzero",
            F.col("_q")[0].alias("q10"),
            F.col("_q")[1].alias("median"),
            F.col("_q")[2].alias("q90"),
            "share_near_zero",
            "share_near_one",
        )
    )


def saturation(pair_table: DataFrame, groups: list[str], multipliers: list[float]) -> DataFrame:
    """Similarity distribution of non-identical pairs at several length-scale multipliers."""
    long = by_component(pair_table, "d", "_d").where(F.col("_d").isNotNull())
    keys = [*groups, "component"]
    scaled = long.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in multipliers])))
    k = F.when(
        F.col("_d") > IDENTICAL, rbf(F.col("_d"), F.col("multiplier") * F.col("scale"))
    )
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    q = F.percentile(F.col("_k"), F.array(*[F.lit(p) for p in probs]))
    out = (
        scaled.withColumn("_k", k)
        .groupBy(*keys, "multiplier", "scale")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.count_if(F.col("_k").isNull()).alias("n_identical"),
            q.alias("_q"),
            F.avg((F.col("_k") < 1e-3).cast("double")).alias("share_lt_0p001"),
            F.avg((F.col("_k") < 0.01).cast("double")).alias("share_lt_0p01"),
            F.avg((F.col("_k") > 0.9).cast("double")).alias("share_gt_0p9"),
        )
        .withColumn("fraction_identical", F.col("n_identical") / F.col("n_pairs"))
    )
    for i, p in enumerate(probs):
        out = out.withColumn(f"q{int(p * 100):02d}", F.col("_q")[i])
    return out.drop("_q")


def to_references(
    df: DataFrame,
    key: str,
    named: dict[int, str],
    lengthscale: float,
    n: int,
    width: int,
    sigma_main: float,
    sigma_epi: float,
) -> DataFrame:
    """Similarity of each row to explicitly named reference rows, relative to self-similarity.

    The references are a handful of listed ids; they travel as one array value.
    """
    labels = F.create_map(*[F.lit(v) for kv in named.items() for v in kv])
    refs = df.where(F.col(key).isin(list(named))).agg(
        F.collect_list(F.struct(labels[F.col(key)].alias("reference"), F.col("vec").alias("ref_vec")))
    ).scalar()
    rows = df.withColumn("_r", F.explode(refs)).select(key, "vec", "_r.*")
    d = component_distances("vec", "ref_vec", n, width)
    k = F.transform(d, lambda x: rbf(x, F.lit(lengthscale)))
    own = F.lit(sigma_main**2 + sigma_epi**2)
    return rows.withColumn("similarity", combined(k, sigma_main, sigma_epi) / own).select(
        key, "reference", "similarity"
    )


def correlation_normalise(
    pair_table: DataFrame, diagonal: DataFrame, groups: list[str], value: str, key: str
) -> DataFrame:
    """k_ij / sqrt(k_ii k_jj) with the diagonal floored at 1e-15."""
    a = diagonal.select(*groups, F.col(key).alias("id_a"), F.col("k_self").alias("_ka"))
    b = diagonal.select(*groups, F.col(key).alias("id_b"), F.col("k_self").alias("_kb"))
    floor = F.lit(1e-15)
    root = F.sqrt(F.greatest(F.col("_ka"), floor) * F.greatest(F.col("_kb"), floor))
    return (
        pair_table.join(a, [*groups, "id_a"])
        .join(b, [*groups, "id_b"])
        .withColumn("correlation", F.col(value) / root)
        .drop("_ka", "_kb")
    )


def self_similarity(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    return df.select(*groups, key, dot("vec", "vec").alias("k_self"))


def mean_similarity(pair_table: DataFrame, groups: list[str], value: str | Column) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return pair_table.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(v).alias("mean_similarity")
    )


def dense_correlation(ids: np.ndarray, pdf: pd.DataFrame, value: str) -> np.ndarray:
    """Symmetric matrix with unit diagonal of one panel's pair rows."""
    place = {v: i for i, v in enumerate(ids)}
    k = np.eye(len(ids))
    i = pdf["id_a"].map(place).to_numpy()
    j = pdf["id_b"].map(place).to_numpy()
    k[i, j] = k[j, i] = pdf[value].to_numpy()
    return k


def panel_diversity(
    pair_table: DataFrame,
    group: str,
    value: str,
    largest: int = 512,
    panels: DataFrame | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Mean similarity, log-determinant and isometry per panel of correlation-normalised pairs.

    A panel of one has no pairs; with ``panels`` (one row per member) it counts as mean 0, log-determinant 0 and
    isometry 1. With ``by`` a group holds many panels: they are cut inside its task, and those of one size are
    decomposed together.
    """
    by = by or []

    def diversity(pdf: pd.DataFrame) -> pd.DataFrame:
        panel = pdf.groupby(by, dropna=False).ngroup().to_numpy() if by else np.zeros(len(pdf), dtype=int)
        order = np.argsort(panel, kind="stable")
        ends, cells = pdf[["id_a", "id_b"]].to_numpy(), pdf[value].to_numpy(float)
        matrices: dict[int, list] = {}
        for rows in np.split(order, np.flatnonzero(np.diff(panel[order])) + 1):
            ids, place = np.unique(ends[rows], return_inverse=True)
            if len(ids) > largest:
                raise ValueError(f"panel {pdf[group].iloc[0]} has {len(ids)} members, limit {largest}")
            i, j = place.reshape(-1, 2).T
            k = np.eye(len(ids))
            k[i, j] = k[j, i] = cells[rows]
            matrices.setdefault(len(ids), []).append((rows[0], k))
        means = pd.Series(cells).groupby(panel).mean().to_numpy()
        out = []
        for n, same in matrices.items():
            first = np.array([row for row, _ in same])
            sign, logdet = np.linalg.slogdet(np.stack([k for _, k in same]) + 1e-12 * np.eye(n))
            logdet = np.where(sign > 0, logdet, np.nan)
            out.append(
                pdf.iloc[first][[group, *by]].assign(
                    n=n,
                    mean_similarity=means[panel[first]],
                    log_determinant=logdet,
                    isometry=np.where(sign > 0, np.exp(logdet / n), 0.0),
                )
            )
        return pd.concat(out)

    kinds = dict(pair_table.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in [group, *by])
    schema = f"{keys}, n int, mean_similarity double, log_determinant double, isometry double"
    cells = pair_table.select(group, *by, "id_a", "id_b", value)
    found = spread_out(cells, group).groupBy(group).applyInPandas(diversity, schema)
    if panels is None:
        return found
    single = panels.groupBy(group, *by).agg(F.count(F.lit(1)).cast("int").alias("n")).where("n = 1")
    zero = [F.lit(v).alias(c) for c, v in (("mean_similarity", 0.0), ("log_determinant", 0.0), ("isometry", 1.0))]
    return found.unionByName(single.select(group, *by, "n", *zero))
