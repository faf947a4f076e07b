"""Exact n-of-n bootstrap for groups of any size: draws are dealt down a tree, and no row moves for them.

A draw takes n of n rows with replacement. How many of them fall into a block of rows follows from a binary tree over
the blocks: at every node the draws of all resamples are split by seeded binomials in proportion to the rows on
either side. A task that holds a block walks only its own path, and every task that walks a node finds the same numbers
there, so counts add up to n exactly and do not depend on partitions. Inside a block the draws are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.operators.ranking import row_positions
from platewright.operators.stability import spread_out

BLOCK_ROWS = 1024
# Index draws of a block that are made at a time; they stay in a core's cache.
AT_ONCE = 1 << 17
# Neighbouring blocks that go to the same task, which walks most of their path through the tree once.
RUN = 8


class Tree:
    """Draws per block of one group of ``n`` rows, for ``draws`` resamples."""

    def __init__(self, name: str, n: int, draws: int, seed: int, rows: int = BLOCK_ROWS):
        self.key, self.n, self.draws, self.rows = [seed, crc32(name.encode())], n, draws, rows
        self.nodes: dict[tuple[int, int], np.ndarray] = {(0, -(-n // rows)): np.full(draws, n)}

    def size(self, low: int, high: int) -> int:
        return min(self.n, high * self.rows) - low * self.rows

    def block(self, k: int) -> np.ndarray:
        """Rows that every resample takes from block ``k``."""
        low, high = 0, -(-self.n // self.rows)
        # Nodes off the path are forgotten: blocks come in order, so most of the path is kept from the last one.
        self.nodes = {at: v for at, v in self.nodes.items() if at[0] <= k < at[1]}
        while high - low > 1:
            middle = (low + high) // 2
            if (low, middle) not in self.nodes and (middle, high) not in self.nodes:
                whole = self.nodes[low, high]
                rng = np.random.default_rng([*self.key, low, high])
                left = rng.binomial(whole, self.size(low, middle) / self.size(low, high))
                self.nodes[low, middle], self.nodes[middle, high] = left, whole - left
            low, high = (low, middle) if k < middle else (middle, high)
        return self.nodes[low, high]

    def sums(self, k: int, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` (a row per row of block ``k``) over the rows that each resample takes there."""
        taken = self.block(k)
        rng = np.random.default_rng([*self.key, k, 1 << 31])
        out = np.zeros((self.draws, values.shape[1]))
        ends = np.cumsum(taken)
        columns = np.ascontiguousarray(values.T)
        first = 0
        while first < self.draws:
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
            many = int(ends[last - 1]) - done
            picked = rng.integers(0, len(values), many)
            # Picks of a resample lie next to each other; a resample without any keeps its zero.
            some = np.flatnonzero(taken[first:last]) + first
            starts = ends[some] - taken[some] - done
            for c, column in enumerate(columns):
                if many:
                    out[some, c] = np.add.reduceat(column.take(picked), starts)
            first = last
        return out


def exact_bootstrap_means(
    df: DataFrame, groups: list[str], key: str, values: list[str], draws: int, seed: int = 0, rows: int = BLOCK_ROWS
) -> DataFrame:
    """``groups, draw, values``: mean of every value over each of ``draws`` n-of-n resamples of a group's rows.

    All values see the same resamples. Rows with a missing value take no part. Rows of a group are placed in order of ``key``
    and cut into blocks of ``rows``; each task adds up its blocks, so what is shuffled is one sum per task, group, draw
    and value. The result depends on the keys, the values and the seed, not on partitions.
    """
    clean = df.select(*groups, key, *[F.col(v).cast("double").alias(v) for v in values]).na.drop(subset=values)
    name = F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in groups]) if groups else F.lit("")
    named = clean.withColumn("_group", name)
    placed = row_positions(named, ["_group"], [(key, False)] + [(v, False) for v in values], "_pos")
    placed = placed.withColumn("_block", F.floor((F.col("_pos") - 1) / F.lit(rows)).cast("long"))
    placed = placed.withColumn("_run", F.floor(F.col("_block") / F.lit(RUN)))
    sorted_ = spread_out(placed, "_group", "_run").sortWithinPartitions("_group", "_block", "_pos")
    schema = T.StructType(
        [
            T.StructField("_group", T.StringType()), T.StructField("_n", T.LongType()),
            *[T.StructField(f"_s{i}", T.ArrayType(T.DoubleType())) for i in range(len(values))],
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, name, total = None, None, None
        held: list[pd.DataFrame] = []

        def add(part: pd.DataFrame):
            nonlocal tree, name, total
            g, n = part["_group"].iloc[0], int(part["total"].iloc[0])
            done = None
            if g != name:
                done = flush()
                tree, name, total = Tree(g, n, draws, seed, rows), g, np.zeros((draws, len(values)))
            total += tree.sums(int(part["_block"].iloc[0]), part[values].to_numpy(float))
            return done

        def flush():
            if name is None:
                return None
            return pd.DataFrame([(name, tree.n, *[total[:, i].tolist() for i in range(len(values))])], columns=schema.names)

        for batch in batches:
            # A block may end in a later batch: all but the last one seen are whole.
            rest = pd.concat([*held, batch], ignore_index=True) if held else batch
            change = (rest["_group"] != rest["_group"].shift()) | (rest["_block"] != rest["_block"].shift())
            starts = [*np.flatnonzero(change.to_numpy()), len(rest)]
            for a, b in zip(starts[:-2], starts[1:-1]):
                done = add(rest.iloc[a:b])
                if done is not None:
                    yield done
            held = [rest.iloc[starts[-2] :]] if len(rest) else []
        if held and len(held[0]):
            done = add(held[0])
            if done is not None:
                yield done
        done = flush()
        if done is not None:
            yield done

    columns = ["_group", "_block", "total", *values]
    parts = sorted_.select(*columns).mapInPandas(run, schema)
    sums = [f"_s{i}" for i in range(len(values))]
    long = parts.select("_group", "_n", F.posexplode(F.arrays_zip(*sums)).alias("draw", "_z"))
    means = long.groupBy("_group", "draw").agg(
        *[(F.sum(f"_z.{s}") / F.first("_n")).alias(v) for s, v in zip(sums, values, strict=True)]
    )
    names = named.select(*groups, "_group").distinct() if groups else None
    out = means.join(names, "_group") if groups else means
    return out.select(*groups, F.col("draw").cast("long").alias("draw"), *values)
