"""Merkle manifest of a data set: one tree per group, a tree over the groups' roots, and a proof per row.

Nodes of a level are rows ``(g, i, n, digest)``: tree, place, nodes of that tree at that level. Every level joins the
nodes with themselves on the computed index of the sibling (exclusive or for binary trees, slot offsets otherwise),
and the rows of slot zero emit the parents. Keys of these joins are unique, so a tree that holds a third of all rows
spreads like any other. Proofs run back down: a node's proof is its siblings followed by its parent's proof.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewright.llm.store import saved

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
# Levels of proofs that one plan holds before its rows are written.
LEVELS_PER_PLAN = 6
PATH = "array<struct<left:binary,right:binary>>"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(text: Column) -> Column:
    """sha256 of a string's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf_digest(values: list[Column]) -> Column:
    return digest_of(F.concat(*[field(v) for v in values]))


def positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place from 0 inside ``tree`` (never null) by ``order``, nulls first.

    Range slices number their rows while sorted; a slice's part of a tree starts after the tree's rows in earlier
    slices. One row per tree and slice meets in the window. The sliced rows are written, as range bounds are sampled.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    sliced = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sliced = saved(sliced.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    sliced = sliced.withColumn("_slice", F.shiftright("_at", 33))
    parts = sliced.groupBy(tree, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(tree).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    parts = saved(parts.select(tree, "_slice", "_first", "_before"), "merkle-slices")
    placed = sliced.join(parts, [tree, "_slice"]).withColumn("i", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_at", "_slice", "_first", "_before")


def sibling_index(offset: int, arity: int) -> str:
    """Place of the ``offset``-th sibling, which need not exist, as SQL."""
    return "i ^ 1L" if arity == 2 else f"i - i % {arity} + (i % {arity} + {offset}) % {arity}"


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``left`` and ``right``: digests of the run's other nodes on either side, joined up."""
    out, seen = nodes, []
    for k in range(1, arity):
        other = nodes.selectExpr("g AS _g", "i AS _i", f"digest AS _d{k}")
        out = out.join(other, F.expr(f"g = _g AND {sibling_index(k, arity)} = _i"), "left").drop("_g", "_i")
        seen.append(f"named_struct('slot', (i + {k}) % {arity}, 'digest', _d{k})")
    run = f"array_sort(filter(array({', '.join(seen)}), s -> s.digest IS NOT NULL))"
    side = "aggregate(filter({0}, s -> s.slot {1} i % {2}), X'', (a, s) -> concat(a, s.digest)) AS {3}"
    kept = [f"`{c}`" for c in nodes.columns]
    return out.selectExpr(*kept, side.format(run, "<", arity, "left"), side.format(run, ">", arity, "right"))


def ascend(nodes: DataFrame, most: int, arity: int) -> list[DataFrame]:
    """The written levels of all trees, from the leaves to the last tree's root; ``most``: leaves of the largest tree.

    A tree's root is its row with ``n`` = 1, which stands in one level only.
    """
    levels = []
    while True:
        levels.append(saved(with_siblings(nodes, arity), "merkle-level"))
        if most <= 1:
            return levels
        nodes = levels[-1].where(f"i % {arity} = 0 AND n > 1").selectExpr(
            "g", f"i div {arity} AS i", f"(n + {arity - 1}) div {arity} AS n",
            "unhex(sha2(cast(concat(lower(hex(digest)), lower(hex(right))) AS binary), 256)) AS digest",
        )
        most = -(-most // arity)


def roots(levels: list[DataFrame]) -> DataFrame:
    """``g, level, digest`` of every tree's root."""
    out = None
    for k, level in enumerate(levels):
        one = level.where("n = 1").selectExpr("g", f"{k} AS level", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The rows of the lowest level with ``path``: their siblings, level by level, then those above their tree.

    ``tops``: ``g, level, path`` of every tree's root. A path is an array of (left, right), an entry per level.
    """
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        above = tops.where(f"level = {k}").selectExpr("g AS _g", "0L AS _i", "path AS _path")
        if paths is not None:
            above = above.unionByName(paths.selectExpr("g AS _g", "i AS _i", "path AS _path"))
        up = F.expr(f"g = _g AND CASE WHEN n > 1 THEN i div {arity} ELSE 0L END = _i")
        own = "CASE WHEN n > 1 THEN array(named_struct('left', left, 'right', right)) ELSE array() END"
        kept = [f"`{c}`" for c in levels[k].columns] if k == 0 else ["g", "i"]
        paths = levels[k].join(above, up).selectExpr(*kept, f"concat({own}, _path) AS path")
        if k and k % LEVELS_PER_PLAN == 0:
            paths = saved(paths, "merkle-paths")
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf (hex text) and its path lead to."""
    return F.aggregate(
        path, leaf, lambda a, s: F.sha2(F.concat(hexed(s["left"]), a, hexed(s["right"])).cast("binary"), 256)
    )


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a path, left to right and level by level."""
    joined = F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")
    return F.sha2(joined.cast("binary"), 256)


@dataclass
class Manifest:
    """The written trees: ``leaves`` holds each row's key, digests and ``path``; ``root`` is None for no rows."""

    leaves: DataFrame
    root: str | None


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    tree: str = "lang",
    key: str = "doc_id",
    claims: dict[str, Column] | None = None,
    arity: int = ARITY,
) -> Manifest:
    """Trees over ``columns`` of every row, one tree per value of ``tree``, leaves in order of ``key``.

    ``claims`` replaces columns by other expressions in a second leaf digest, ``claim``, which takes no part in the
    trees: what a holder of the row says its content is. Without claims it equals the leaf.

    ``leaves`` has ``key, leaf, claim, subroot`` (hex text) and ``path``. Nulls are fields of their own; null keys come
    first in their tree, rows alike in key by leaf digest, and rows alike in all are interchangeable. A null tree value
    is a tree of its own and the first. Empty texts are fields of no bytes, so not nulls. A tree of one row is its
    leaf. Other columns, whatever their names, take no part. Texts are read once; digests are what is shuffled.
    """
    if arity < 2:
        raise ValueError("a tree needs an arity of 2 at least")
    said = claims or {}
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(tree).alias("tree"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        leaf_digest([said.get(c, F.col(c)) for c in columns]).alias("claim"),
    )
    rows = saved(rows, "merkle-leaves")
    trees = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    trees = positions(trees, "all", ["tree"]).select(F.col("tree").alias("_tree"), F.col("i").alias("g"), "n")
    trees = saved(trees, "merkle-trees")
    n_trees, most = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    if not n_trees:
        none = rows.select("key", F.lit("").alias("leaf"), F.lit("").alias("claim"), F.lit("").alias("subroot"))
        return Manifest(none.withColumn("path", F.array().cast(PATH)), None)
    keyed = rows.join(trees, F.col("tree").eqNullSafe(F.col("_tree"))).drop("tree", "_tree")
    levels = ascend(positions(keyed, "g", ["key", "digest", "claim"]), most, arity)
    subroots = saved(roots(levels), "merkle-roots")
    upper = subroots.select(
        F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n_trees).cast("long").alias("n"), "digest", "level"
    )
    upper = ascend(upper, n_trees, arity)
    top = roots(upper)
    root = top.select(hexed(F.col("digest"))).first()[0]
    tops = descend(upper, top.select("g", "level", F.array().cast(PATH).alias("path")), arity)
    tops = saved(tops.select(F.col("i").alias("g"), "level", "digest", "path"), "merkle-tops")
    leaves = descend(levels, tops.select("g", "level", "path"), arity)
    named = tops.select(F.col("g").alias("_g"), hexed(F.col("digest")).alias("subroot"))
    leaves = leaves.join(named, F.col("g") == F.col("_g"))
    return Manifest(
        leaves.select("key", hexed(F.col("digest")).alias("leaf"), hexed(F.col("claim")).alias("claim"), "subroot", "path"),
        root,
    )


def verified(made: Manifest) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified``: every claim folded along its row's path."""
    root = F.lit(made.root).cast("string")
    out = made.leaves.withColumn("root", root).withColumn("folded_root", fold(F.col("claim"), F.col("path")))
    return out.select(
        "key", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
