"""Row-set encodings of variants: indicator tables, descriptors, observed residue sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sparse_indicators(df: DataFrame, key: str, items: Column) -> DataFrame:
    """Long (key, item) form: the scalable shape of dynamic indicator columns."""
    return df.select(key, F.explode(F.array_distinct(items)).alias("item"))


def indicator_columns(df: DataFrame, key: str, items: Column, wanted: list[str]) -> DataFrame:
    """One 0/1 column per listed item, straight from the row's array: no shuffle, no pivot."""
    return df.select(
        key, *[F.array_contains(items, F.lit(w)).cast("int").alias(w) for w in wanted]
    )


def lookup_residues(df: DataFrame, key: str, pocket: str, lookup: DataFrame, columns: list[str]) -> DataFrame:
    """(key, slot, residue, descriptors...) with NULL descriptors for an unknown residue.

    The lookup holds one row per residue letter; Spark decides on broadcasting from its size.
    """
    exploded = df.select(key, F.posexplode(pocket).alias("slot", "residue"))
    return exploded.join(lookup.select("residue", *columns), "residue", "left")


def concatenated_descriptors(
    df: DataFrame, key: str, pocket: str, lookup: DataFrame, columns: list[str]
) -> DataFrame:
    """Descriptor vector of every row, slots in order.

    The whole lookup is one map value (one entry per letter), so rows are encoded in place and the
    table is not shuffled.
    """
    entries = F.collect_list(F.struct("residue", F.array(*[F.col(c) for c in columns])))
    table = lookup.agg(F.map_from_entries(entries)).scalar()
    with_table = df.select(key, pocket, table.alias("_map"))
    vec = F.flatten(F.transform(F.col(pocket), lambda r: F.element_at(F.col("_map"), r)))
    return with_table.select(key, vec.alias("vec"))


def observed_sets(df: DataFrame, pocket: str, n_slots: int) -> DataFrame:
    """Distinct residues seen at each slot, with counts. At most (slots x letters) rows leave."""
    exploded = df.select(F.posexplode(pocket).alias("slot", "residue"))
    counts = exploded.groupBy("slot", "residue").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("slot").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("n").alias("n_rows"),
        F.array_sort(F.collect_set("residue")).alias("residues"),
    )
