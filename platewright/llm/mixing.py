"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewright.functions.common import hash60
from platewright.llm.store import saved
from platewright.llm.words import word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source, source_size`` -> with ``target``: words each source should give.

    Sources in code point order (null last) get the weights in turn and split ``share`` of all words by
    weight. A target stops at ``most`` times its source's words; what is over is shared again by weight until
    none is above. In closed form: with sources in order of size per weight, a source is capped as long as
    the level that the rest would get reaches its cap. No words at all give targets of zero.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    total = F.lit(share) * F.sum("source_size").over(W.partitionBy())
    rest = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("w").over(W.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("level", rest / left)
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(W.partitionBy())
    target = F.when(F.col("capped"), F.col("cap")).otherwise(final["level"] * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A source's random offset in [0, 1), fixed by the seed."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), source), F.lit("-")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def shuffled(key: Column, seed: int) -> Column:
    """Order of documents of one size: a hash of the key, the same in every run."""
    return hash60(F.lit(str(seed)), key)


def copies(
    rows: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 0,
) -> DataFrame:
    """``key, source, size`` -> with ``source_size, target, copies``.

    Every document of a source expects target / source_size copies. In the order (size, hash of key), the
    running sum of expected copies plus the source's offset crosses whole numbers; a document is emitted once
    per crossing. Neighbours in that order have like sizes, so the words taken stay within about one
    document of the target. The running sum is rank times rate, and ranks come from range-partitioned slices
    plus the sizes of earlier slices: a source of any share of the rows spreads over many tasks. The sliced
    table is written once, because range bounds are sampled.
    """
    narrow = rows.withColumn("h", shuffled(F.col("key"), seed))
    sliced = narrow.repartitionByRange("source", "size", "h", "key").sortWithinPartitions("source", "size", "h", "key")
    sliced = saved(sliced.withColumn("slice", F.spark_partition_id()), "slices")
    slices = sliced.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    earlier = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    targets = source_targets(slices.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = targets.withColumnRenamed("source", "p_source")
    plan = slices.join(targets, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "p_source", F.col("slice").alias("p_slice"), "before", "source_size", "target"
    )
    here = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice"))
    within = W.partitionBy("source", "slice").orderBy("size", "h", "key")
    ranked = (
        sliced.withColumn("i", F.row_number().over(within))
        .join(plan, here)
        .withColumn("rank", F.col("before") + F.col("i"))
    )
    # A source without words has nothing to fill: its documents are of size 0 and are not taken.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = lambda r: F.floor(r * F.col("rate") + F.col("u"))
    return (
        ranked.withColumn("rate", rate)
        .withColumn("u", offset(F.col("source"), seed))
        .withColumn("copies", (at(F.col("rank")) - at(F.col("rank") - 1)).cast("long"))
        .select("key", "source", "size", "source_size", "target", "copies")
    )


def mix(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **settings
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies``.

    Size is the number of words (null text: 0) and ``taken`` the words of all copies. A null source is a
    source of its own; null ids and repeated rows keep a row each, and rows alike in id, size and source are
    interchangeable; an empty table gives no rows; further columns are ignored. The seed fixes the result.
    """
    rows = docs.select(
        F.col(doc_id).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    )
    return copies(rows, **settings).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )


def mixed_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **settings
) -> DataFrame:
    """The mix itself: each document once per copy, all columns as they were and ``copy`` (from 1) added.

    Rows alike in id and text share their copies evenly. An existing column ``copy`` is replaced.
    """
    key = F.struct(F.col(doc_id).cast("string").alias("id"), F.xxhash64(F.col(text)).alias("h"))
    rows = docs.select(key.alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = rows.withColumn("key", F.to_json("key"))
    drawn = copies(rows, **settings).groupBy("key").agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")
    )
    drawn = drawn.where("_copies > 0").select(F.col("key").alias("_key"), "_copies", "_rows")
    both = docs.withColumn("_key", F.to_json(key)).join(drawn, "_key")
    turn = F.when(F.col("_rows") > 1, F.row_number().over(W.partitionBy("_key").orderBy("_key"))).otherwise(1)
    both = both.withColumn("_turn", turn)
    own = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_turn") <= F.col("_copies") % F.col("_rows")).cast("long")
    counted = both.withColumn("_own", own).where("_own > 0")
    names = [F.col(f"`{c}`") for c in docs.columns if c != "copy"]
    return counted.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_own"))).alias("copy"))
