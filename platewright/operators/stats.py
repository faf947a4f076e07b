"""Paired tests, resampling and multiplicity over prediction tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.functions.common import TWO_32, correlation, hash32, hash60
from platewright.functions.digests import prefixed_digests
from platewright.functions.normal import two_sided_p
from platewright.operators.index_draws import DRAWS_AT_ONCE, HELD_BYTES, Orders, batches_of, count_picks, draw_tasks
from platewright.operators.metrics import rank_correlation
from platewright.operators.ranking import (
    average_ranks,
    group_quantiles,
    row_positions,
    value_positions,
)
from platewright.operators.stability import attach, spread_out, spread_rows, written

# Cumulative Poisson(1) probabilities P(W <= 0), P(W <= 1), ... down to 32-bit resolution.
POISSON_STEPS = (
    0.3678794412, 0.7357588823, 0.9196986029, 0.9810118431, 0.9963401532,
    0.9994058152, 0.9999167589, 0.9999897508, 0.9999988748, 0.9999998885,
)
DRAWS_PER_HASH = 4
# Hashes that one task makes, and groups whose sums it holds before it passes them on.
TASK_DIGESTS = 25_000_000
HELD_GROUPS = 64
# Counts of picks, one per row and draw, that a task holds.
BLOCK_PICKS = 1 << 25


def poisson_thresholds() -> list[str]:
    """The steps as 8-digit hex text: a hash digit group is compared as text, without conversion."""
    return [f"{int(np.ceil(p * TWO_32)):08x}" for p in POISSON_STEPS]


def with_scopes(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """Each row once per scope it belongs to (a fixed short list of named predicates)."""
    marks = F.array(*[F.when(c, F.lit(name)) for name, c in scopes.items()])
    return df.withColumn("scope", F.explode(F.array_compact(marks)))


def share_at_or_below(
    null: DataFrame, points: DataFrame, groups: list[str], sample: str, value: str
) -> DataFrame:
    """Percentile position of one value per group within its null distribution."""
    hit = (F.col(sample) <= F.col(value)).cast("double")
    return (
        attach(null.select(*groups, sample), points.select(*groups, value), groups)
        .groupBy(*groups, value)
        .agg(F.avg(hit).alias("share_at_or_below"))
    )


def resample_by_index(
    df: DataFrame, groups: list[str], key: str, values: list[str], draws: int
) -> DataFrame:
    """n-of-n resampling with replacement: (groups, draw, values...) rows.

    Slot i of draw d takes the row at position hash(d, i) mod n. Positions are unique per group, so
    the join spreads evenly whatever the group sizes are.
    """
    placed = row_positions(df.select(*groups, key, *values), groups, [(key, False)], "_pos")
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    slots = spread_out(placed, "_pos").select(*groups, "_pos", "total", draw.alias("draw")).select(
        *groups,
        "draw",
        (F.pmod(hash60("draw", F.col("_pos") - 1), F.col("total")) + 1).alias("_pos"),
    )
    return slots.join(placed.select(*groups, "_pos", *values), [*groups, "_pos"]).drop("_pos")


def bootstrap_means(
    df: DataFrame, groups: list[str], key: str, values: list[str], draws: int
) -> DataFrame:
    """Mean of every value per draw; all values see the same resamples, those of ``resample_by_index``.

    No row is made per draw and slot: a task takes some draws, counts their picks of every row and reads the written
    rows against the counts, ``BLOCK_PICKS`` counts at a time. What leaves a task is its means.
    """
    order = [(g, False) for g in groups] + [(key, False)]
    located = row_positions(df.select(*groups, key, *values), [], order, "_at").withColumn("_at", F.col("_at") - 1)
    placed = written(located.select(*groups, "_at", *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]), "placed")
    sizes = written(placed.groupBy(*groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_total")), "sizes")
    spark, rows = df.sparkSession, placed.count()
    files, size_files = list(placed.inputFiles()), list(sizes.inputFiles())
    at_once = max(1, BLOCK_PICKS // max(1, rows))
    columns = [f"_v{i}" for i in range(len(values))]
    sums = [f"{kind}{i}" for i in range(len(values)) for kind in ("_s", "_n")]
    longs = [T.StructField(c, T.LongType()) for c in ("_first", "draw")]
    schema = T.StructType([*longs, *[T.StructField(c, T.DoubleType()) for c in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches_of(size_files, ["_first", "_total"], 1 << 16))
        first, total = (np.concatenate([np.zeros(0, np.int64), *[p.column(c).to_numpy() for p in parts]]) for c in ("_first", "_total"))
        place = np.argsort(first)
        first, total = first[place], total[place]
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for lo in range(0, len(numbers), at_once):
                some = numbers[lo : lo + at_once]
                counts = count_picks(some, first, total)
                found = np.zeros((len(sums), len(first), len(some)))
                for part in batches_of(files, ["_at", *columns], min(8192, max(1024, (1 << 18) // len(some)))):
                    at = part.column("_at").to_numpy()
                    x = np.empty((len(sums), len(at)))
                    for i, c in enumerate(columns):
                        column = part.column(c)
                        x[2 * i] = pc.fill_null(column, 0.0).to_numpy()
                        x[2 * i + 1] = pc.is_valid(column).to_numpy(zero_copy_only=False)
                    group = np.searchsorted(first, at, side="right") - 1
                    for g in np.unique(group):
                        mine = slice(None) if len(first) == 1 else group == g
                        found[:, g] += np.vecdot(counts.take(at[mine], axis=1).astype(float), x[:, None, mine])
                lines = found.reshape(len(sums), -1)
                names = [np.repeat(first, len(some)), np.tile(np.array(some, dtype=np.int64), len(first))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*names, *lines)], names=schema.names)

    tasks = draw_tasks(rows, draws, spark.sparkContext.defaultParallelism)
    found = spark.range(0, draws, 1, tasks).mapInArrow(run, schema)
    means = [F.try_divide(f"_s{i}", f"_n{i}").alias(v) for i, v in enumerate(values)]
    return found.join(sizes, "_first").select(*groups, "draw", *means)


def _digests(prefixes: range, keys: list, words: int) -> np.ndarray:
    """md5 of 'prefix|key' as big-endian 32-bit words, shape (prefix, key, words); the same as the SQL hashes."""
    return prefixed_digests(prefixes, keys)[:words].transpose(1, 2, 0)


def poisson_bootstrap_means(
    df: DataFrame, groups: list[str], key: str, values: list[str], draws: int, rows: int = 2000
) -> DataFrame:
    """Poisson-weighted bootstrap means for groups of any size.

    The weights of all draws are made for ``rows`` rows at a time and added up at once, as a matrix product; only
    (group, draw) partial sums are shuffled. There is a task per ``TASK_DIGESTS`` hashes, so none grows with the table.
    """
    fields = [df.schema[g] for g in groups]
    sums = [T.StructField(f"_s{i}", T.DoubleType()) for i in range(len(values) + 1)]
    schema = T.StructType([*fields, T.StructField("draw", T.LongType()), *sums])
    limits = np.array([int(t, 16) for t in poisson_thresholds()], dtype=np.uint32)
    hashes = range((draws - 1) // DRAWS_PER_HASH + 1)

    def weights(keys: list) -> np.ndarray:
        bits = prefixed_digests(hashes, keys).transpose(1, 0, 2).reshape(-1, len(keys))[:draws]
        w = np.zeros(bits.shape, dtype=np.uint8)
        for limit in limits:
            w += bits >= limit
        return w.astype(float)

    def emitted(held: dict) -> Iterator[pd.DataFrame]:
        for name, found in held.items():
            out = pd.DataFrame(found, columns=[f.name for f in sums])
            out.insert(0, "draw", np.arange(draws))
            for i, g in enumerate(groups):
                out.insert(i, g, name[i])
            yield out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                units = part.groupby(groups, dropna=False, sort=False) if groups else [((), part)]
                for name, unit in units:
                    x = unit[values].to_numpy(float)
                    found = weights(unit[key].tolist()) @ np.column_stack([x, np.ones(len(x))])
                    held[name] = held[name] + found if name in held else found
                    if len(held) >= HELD_GROUPS:
                        yield from emitted(held)
                        held = {}
        yield from emitted(held)

    usable = written(df.select(*groups, key, *values).na.drop(subset=values), "weighted")
    parts = spread_rows(usable, TASK_DIGESTS // len(hashes), key).mapInPandas(run, schema)
    total = F.sum(sums[-1].name)
    return parts.groupBy(*groups, "draw").agg(
        *[F.try_divide(F.sum(f"_s{i}"), total).alias(v) for i, v in enumerate(values)]
    )


def percentile_interval(
    draws: DataFrame, groups: list[str], values: list[str], alpha: float = 0.05
) -> DataFrame:
    """Percentile interval per value over the draws (a bounded number of rows per group).

    Degenerate draws (NULL or NaN) are ignored.
    """
    long = draws.unpivot(groups, values, "statistic", "_v")
    clean = F.when(~F.isnan("_v"), F.col("_v"))
    ends = F.percentile(clean, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return (
        long.groupBy(*groups, "statistic")
        .agg(ends.alias("_e"))
        .select(
            *groups,
            "statistic",
            F.col("_e")[0].alias("ci_low"),
            F.col("_e")[1].alias("ci_high"),
        )
    )


def paired_differences(
    df: DataFrame, model: str, key: str, error: str, focuses: list[str] | None = None
) -> DataFrame:
    """(focus, against, key, both errors, difference) for every ordered pair of models of a key.

    Positive differences mean the focus model made the smaller error. A key has one row per model.
    """
    a = df.select(F.col(model).alias("focus"), key, F.col(error).alias("focus_error"))
    b = df.select(F.col(model).alias("against"), key, F.col(error).alias("against_error"))
    if focuses is not None:
        a = a.where(F.col("focus").isin(focuses))
    return (
        a.join(b, key)
        .where(F.col("focus") != F.col("against"))
        .withColumn("difference", F.col("against_error") - F.col("focus_error"))
    )


def mirror(tests: DataFrame) -> DataFrame:
    """Results of unordered model pairs also from the other side: the statistic is symmetric."""
    swapped = {"focus": "against", "against": "focus", "w_plus": "w_minus", "w_minus": "w_plus"}
    other = tests.select(*[F.col(swapped.get(c, c)).alias(c) for c in tests.columns])
    return tests.unionByName(other)


def paired_summary(differences: DataFrame, groups: list[str]) -> DataFrame:
    """Both MAEs, mean and median difference, and how often the focus model is better."""
    flat = differences.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("focus_error").alias("focus_mae"),
        F.avg("against_error").alias("against_mae"),
        F.avg("difference").alias("delta_mean"),
        F.count_if(F.col("difference") > 0).alias("n_focus_better"),
    )
    return flat.join(group_quantiles(differences, groups, "difference", {"delta_median": 0.5}), groups)


def wilcoxon(
    df: DataFrame, groups: list[str], difference: str, p_if_all_zero: float | None = 1.0
) -> DataFrame:
    """Signed-rank statistic with tie-corrected normal p-value. Zero differences are dropped.

    Rank sums come from distinct |difference| values with their signed counts, so ties collapse
    before the sort and no group is ranked in one task. The zeros of a group sort first; their
    number is taken off its rank sums, which keeps all-zero groups in the same single pass.
    """
    sized = df.where(F.col(difference).isNotNull()).select(
        *groups, F.abs(difference).alias("_a"), (F.col(difference) > 0).cast("int").alias("_up")
    )
    rows = value_positions(sized, groups, "_a", {"_n_up": F.sum("_up")}).withColumn(
        "_rank", F.col("before") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    )
    real = F.col("_a") > 0
    down = F.col("n") - F.col("_n_up")
    m, zeros = F.col("n").cast("double"), F.col("_zeros")
    sums = rows.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("_zeros"),
        F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("n"),
        F.sum(F.when(real, F.col("_rank") * F.col("_n_up"))).alias("_sum_up"),
        F.sum(F.when(real, F.col("_rank") * down)).alias("_sum_down"),
        F.sum(F.when(real, F.col("_n_up"))).alias("_ups"),
        F.sum(F.when(real, down)).alias("_downs"),
        F.sum(F.when(real, m * m * m - m)).alias("_t"),
        F.max(F.when(real, F.col("n"))).alias("largest_tie"),
    )
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48
    p = F.when(F.col("n") > 0, two_sided_p("z")).otherwise(F.lit(p_if_all_zero).cast("double"))
    return (
        sums.withColumn("w_plus", F.col("_sum_up") - zeros * F.col("_ups"))
        .withColumn("w_minus", F.col("_sum_down") - zeros * F.col("_downs"))
        .withColumn("statistic", F.least("w_plus", "w_minus"))
        .withColumn("z", F.when(var > 0, (F.col("statistic") - mean) / F.sqrt(var)))
        .withColumn("p", p)
        .drop("_zeros", "_sum_up", "_sum_down", "_ups", "_downs", "_t")
    )


def _signed_rank_tail(n: int, w: float) -> float:
    """P(min rank sum <= w) two-sided, by counting subsets of 1..n with a given sum."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for r in range(1, n + 1):
        counts[r:] = counts[r:] + counts[:-r]
    return float(min(1.0, 2.0 * counts[: int(np.floor(w)) + 1].sum() / 2.0**n))


def exact_wilcoxon(tests: DataFrame, largest: int = 200) -> DataFrame:
    """Adds ``p_exact`` next to the normal ``p``, and ``exact_status``; which of the two to report is the caller's choice.

    Only (n, statistic) is needed, so this is a vectorised function over the test table. The exact distribution
    holds for untied differences (status ``tied`` otherwise) and its table has n^2 / 2 entries, so tests of more
    than ``largest`` differences have status ``too_large``. Both leave ``p_exact`` null; ``p`` is the same for all.
    """

    @F.pandas_udf("double")
    def exact(n: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(b) or a < 1 else _signed_rank_tail(int(a), float(b)) for a, b in zip(n, w)],
            dtype="float64",
        )

    status = (
        F.when(F.coalesce(F.col("n"), F.lit(0)) < 1, "empty")
        .when(F.col("largest_tie") > 1, "tied")
        .when(F.col("n") > largest, "too_large")
        .otherwise("exact")
    )
    safe_n = F.when(F.col("exact_status") == "exact", F.col("n")).otherwise(F.lit(0))
    return tests.withColumn("exact_status", status).withColumn("p_exact", exact(safe_n, F.col("statistic")))


def bootstrap_rank_differences(
    wide: DataFrame, key: str, truth: str, focus: str, against: list[str], draws: int
) -> DataFrame:
    """Difference of Spearman rho (focus minus each opponent) for every resample of the keys, those of ``resample_by_index``.

    Rows are ranked once. A task takes some draws, counts their picks of every row and runs through the rows in the order of
    every measure: the counts before a row give its tie-averaged rank in the draw. What leaves a task is its differences.
    """
    measures = [truth, focus, *against]
    located = row_positions(wide.select(key, *measures), [], [(key, False)], "_at")
    values = [F.struct(F.lit(i).alias("_measure"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(measures)]
    long = located.select((F.col("_at") - 1).alias("_at"), F.explode(F.array(*values)).alias("_m")).select("_at", "_m.*")
    ranked = average_ranks(long, ["_measure"], {"_x": "_rank"})
    twice = F.coalesce((2 * F.col("_rank")).cast("int"), F.lit(0))
    ranked = written(ranked.select("_measure", "_at", twice.alias("_twice")), "ranked")
    spark, rows = wide.sparkSession, ranked.count() // len(measures)
    files = list(ranked.inputFiles())
    at_once = max(1, min(DRAWS_AT_ONCE, HELD_BYTES // (6 * max(1, rows))))
    schema = T.StructType([T.StructField("draw", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in against]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.zeros((len(measures), rows), dtype=np.int32)
        for part in batches_of(files, ["_measure", "_at", "_twice"], 1 << 16):
            ranks[part.column("_measure").to_numpy(), part.column("_at").to_numpy()] = part.column("_twice").to_numpy()
        orders = Orders(ranks)
        del ranks
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for lo in range(0, len(numbers), at_once):
                some = numbers[lo : lo + at_once]
                counts = count_picks(some, np.zeros(1, np.int64), np.array([rows]))
                rho = orders.correlations(np.ascontiguousarray(counts.T))
                columns = [pa.array(rho[:, 0] - other, from_pandas=True) for other in rho[:, 1:].T]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *columns], names=schema.names)

    tasks = draw_tasks(rows, draws if rows else 0, spark.sparkContext.defaultParallelism)
    return spark.range(0, draws if rows else 0, 1, tasks).mapInArrow(run, schema)


def rank_correlation_test(
    df: DataFrame, groups: list[str], x: str = "observed", y: str = "predicted"
) -> DataFrame:
    """Spearman rho with a Fisher-z p-value (variance 1.06/(n - 3))."""
    rho = rank_correlation(df, groups, x, y)
    n = df.na.drop(subset=[x, y]).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    r = F.col("spearman")
    z = F.lit(0.5) * F.log((1 + r) / (1 - r)) * F.sqrt((F.col("n") - 3) / F.lit(1.06))
    return (
        n.join(rho, groups)
        .withColumn("z", F.when((F.col("n") > 3) & (F.abs(r) < 1), z))
        .withColumn("p", two_sided_p("z"))
    )


def permutation_test_grouped(
    df: DataFrame, group: str, key: str, x: str, y: str, permutations: int
) -> DataFrame:
    """The same test for bounded groups: all permutations of a group in one task, one shuffle of the rows.

    ``permutation_test`` is the form for groups of any size. Rows with a missing side take no part; a group with a
    constant side has neither rho nor p.
    """
    schema = T.StructType(
        [df.schema[group], T.StructField("rho", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("p", T.DoubleType())]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        rx, ry = pdf[x].rank().to_numpy(), pdf[y].rank().to_numpy()
        a, b = rx - rx.mean(), ry - ry.mean()
        scale = np.sqrt((a @ a) * (b @ b))
        rho = p = None
        if scale > 0:
            rho, hits, keys = float(a @ b / scale), 0, pdf[key].tolist()
            step = max(1, 2_000_000 // len(pdf))
            for lo in range(0, permutations, step):
                h = _digests(range(lo, min(permutations, lo + step)), keys, 1)[..., 0]
                null = a[np.argsort(h, axis=1, kind="stable")] @ b / scale
                hits += int((np.abs(null) >= abs(rho) - 1e-12).sum())
            p = hits / permutations
        return pd.DataFrame([(pdf[group].iloc[0], rho, len(pdf), p)], columns=schema.names)

    rows = df.select(group, key, x, y).na.drop(subset=[x, y])
    return spread_out(rows, group).groupBy(group).applyInPandas(run, schema)


def subset_share_grouped(
    members: DataFrame, pairs: DataFrame, group: str, key: str, value: str, best: str, k: int, draws: int
) -> DataFrame:
    """Mean similarity of the k members of largest ``best`` and the share of random k-subsets at or below it.

    For bounded groups: members and pair table of a group meet in one task, which makes all subsets. Subset d
    holds the first k by hash of (d, key). A group of fewer than two members or without pairs has nulls.
    """
    fields = [T.StructField(n, T.DoubleType()) for n in ("observed", "share_at_or_below")]
    schema = T.StructType([members.schema[group], *fields])

    def run(m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        name = m[group].iloc[0] if len(m) else p[group].iloc[0]
        if len(m) < 2 or p.empty:
            return pd.DataFrame([(name, None, None)], columns=schema.names)
        m = m.sort_values(key)
        place = pd.Series(np.arange(len(m)), index=m[key])
        c = np.zeros((len(m), len(m)))
        i, j = place[p["id_a"]].to_numpy(), place[p["id_b"]].to_numpy()
        c[i, j] = c[j, i] = p[value]
        size = min(k, len(m))
        h = _digests(range(draws), m[key].tolist(), 1)[..., 0]
        picks = np.argsort(h, axis=1, kind="stable")[:, :size]
        mean = lambda s: c[s[:, :, None], s[:, None, :]].sum(axis=(1, 2)) / (size * (size - 1))
        top = np.lexsort((m[key], -m[best]))[:size]
        observed = float(mean(top[None, :])[0])
        share = float((mean(picks) <= observed + 1e-12).mean())
        return pd.DataFrame([(name, observed, share)], columns=schema.names)

    left = spread_out(members.select(group, key, best), group).groupBy(group)
    return left.cogroup(pairs.select(group, "id_a", "id_b", value).groupBy(group)).applyInPandas(run, schema)


def permutation_test(
    df: DataFrame, groups: list[str], key: str, x: str, y: str, permutations: int
) -> DataFrame:
    """Two-sided permutation p of a rank correlation: share of |rho| at least the observed one.

    In permutation p the row at hash position j takes the y rank of row j.
    """
    ranked = average_ranks(df.select(*groups, key, x, y), groups, {x: "_rx", y: "_ry"})
    placed = row_positions(ranked.select(*groups, key, "_rx", "_ry"), groups, [(key, False)], "_pos")
    placed = placed.drop("total")
    shuffled = spread_out(placed, key).select(
        *groups,
        key,
        "_rx",
        F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"),
    ).withColumn("_h", hash32("perm", key))
    drawn = row_positions(shuffled, [*groups, "perm"], [("_h", False), (key, False)], "_pos")
    null = (
        drawn.drop("total", "_h")
        .join(placed.select(*groups, "_pos", "_ry"), [*groups, "_pos"])
        .groupBy(*groups, "perm")
        .agg(correlation("_rx", "_ry").alias("_null"))
    )
    observed = ranked.groupBy(*groups).agg(correlation("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))
    extreme = (F.abs("_null") >= F.abs("rho") - F.lit(1e-12)).cast("double")
    return (
        null.join(observed, groups).groupBy(*groups, "rho", "n").agg(F.avg(extreme).alias("p"))
    )


def random_subsets(
    members: DataFrame, group: str, key: str, size: int, draws: int
) -> DataFrame:
    """Hash-random subsets without replacement of each bounded group: (group, draw, key)."""
    from platewright.operators.ranking import top_per_group

    drawn = members.select(
        group, key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    ).withColumn("_h", hash32("draw", key))
    return top_per_group(drawn, [group, "draw"], [("_h", False), (key, False)], size, "_r").drop("_h", "_r")


def subset_similarity(
    subsets: DataFrame, pair_table: DataFrame, group: str, key: str, value: str
) -> DataFrame:
    """Mean pair similarity inside every subset of a bounded group."""
    a = subsets.select(group, "draw", F.col(key).alias("id_a"))
    b = subsets.select(group, "draw", F.col(key).alias("id_b"))
    inside = a.join(b, [group, "draw"]).where(F.col("id_a") < F.col("id_b"))
    return (
        inside.join(pair_table.select(group, "id_a", "id_b", value), [group, "id_a", "id_b"])
        .groupBy(group, "draw")
        .agg(F.avg(value).alias("mean_similarity"))
    )


def leave_one_out_similarity(pair_table: DataFrame, group: str, value: str) -> DataFrame:
    """Mean pair similarity of each panel without each member: total minus the member's pairs."""
    ends = pair_table.select(group, F.explode(F.array("id_a", "id_b")).alias("member"), value)
    rows = ends.groupBy(group, "member").agg(F.sum(value).alias("_row"), F.count(F.lit(1)).alias("_k"))
    totals = pair_table.groupBy(group).agg(F.sum(value).alias("_all"), F.count(F.lit(1)).alias("_n"))
    rest = (F.col("_all") - F.col("_row")) / (F.col("_n") - F.col("_k"))
    loo = rows.join(totals, group).where(F.col("_n") > F.col("_k")).withColumn("_loo", rest)
    return loo.groupBy(group).agg(
        F.avg("_loo").alias("mean"), F.min("_loo").alias("low"), F.max("_loo").alias("high"), F.count(F.lit(1)).alias("n")
    )
