"""SimHash fingerprints and exact linking within a Hamming radius by covering bit masks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.llm.components import connected_components
from platewright.llm.store import saved
from platewright.llm.words import blank_words, utf8

BITS = 64
HASH_SEED = 42
# Shingle hashes are counted bitwise in slices of this many, whatever the length of the text.
SLICE = 1 << 16
# A bucket of more fingerprints is compared in blocks spread over tasks.
BLOCK = 8192


def fingerprint(raw: bytes, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; 0 without words."""
    words = blank_words(raw)
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, SLICE):
        part = hashes[i : i + SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, width: int = 4) -> Column:
    """Fingerprint as a signed long; null text counts as empty."""

    @F.pandas_udf("long")
    def run(raws: pd.Series) -> pd.Series:
        found = np.array([fingerprint(bytes(r), width) for r in raws], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return run(utf8(text))


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` positions are all left out of at least one mask.

    Bit i gets a non-zero vector m(i) of radius+1 bits; mask v keeps the bits with odd parity of v & m(i). Up
    to ``radius`` vectors never span the whole space, so some v is orthogonal to all of them. Vectors are
    dealt evenly, so each mask keeps about half of the bits.
    """
    values = np.arange(1, 2 ** (radius + 1))
    rounds = -(-BITS // len(values))
    rng = np.random.default_rng(seed)
    dealt = np.concatenate([rng.permutation(values) for _ in range(rounds)])[:BITS]
    return [sum(1 << i for i in range(BITS) if (int(v) & int(dealt[i])).bit_count() % 2) for v in values]


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed longs; counted unsigned, as a negative number's bits would be those of its size."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def stars(prints: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning links of the graph "at most ``radius`` differing bits": each node to its component's first.

    A node is compared only with nodes not reached yet, so a dense group costs far less than its pairs.
    """
    ends, roots = [], []
    left = np.arange(len(prints))
    while len(left) > 1:
        root, frontier, left = prints[left[0]], [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = differing(prints[left], prints[x]) <= radius
            if near.any():
                reached = left[near]
                left = left[~near]
                frontier.extend(reached)
                ends.append(prints[reached])
                roots.append(np.full(len(reached), root))
    return ends, roots


LINK_SCHEMA = "a long, b long, t int, key long"
LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32()), ("key", pa.int64())])


def _links(ends: list, roots: list) -> pa.RecordBatch:
    a = np.concatenate(ends).astype(np.int64)
    b = np.concatenate(roots).astype(np.int64)
    empty = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty], schema=LINK_ARROW)


def _overflow(t: np.ndarray, key: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(f), pa.nulls(len(f), pa.int64()), pa.array(t.astype(np.int32)), pa.array(key)]
    return pa.RecordBatch.from_arrays(columns, schema=LINK_ARROW)


def _link_sorted(radius: int, block: int):
    """Rows sorted by (t, key) -> links inside each bucket; rows of a bucket beyond ``block`` pass through."""

    def close(t, key, f) -> Iterator[pa.RecordBatch]:
        if len(f) < 2:
            return
        new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        begin = np.concatenate([[0], new])
        size = np.diff(np.concatenate([begin, [len(f)]]))
        ends, roots = [], []
        two = begin[size == 2]
        near = differing(f[two], f[two + 1]) <= radius
        ends.append(f[two[near] + 1])
        roots.append(f[two[near]])
        for i, n in zip(begin[size > 2], size[size > 2], strict=True):
            if n > block:
                yield _overflow(t[i : i + n], key[i : i + n], f[i : i + n])
                continue
            e, r = stars(f[i : i + n], radius)
            ends += e
            roots += r
        out = _links(ends, roots)
        if out.num_rows:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        hot = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp")]
            if hot is not None:
                same = (rows[0] == hot[0]) & (rows[1] == hot[1])
                if same.any():
                    yield _overflow(*(r[same] for r in rows))
                    rows = [r[~same] for r in rows]
                if not len(rows[0]):
                    continue
                hot = None
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            t, key, _ = rows
            last = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1] + 1) if (
                (t != t[-1]) | (key != key[-1])
            ).any() else 0
            yield from close(*(r[:last] for r in rows))
            held = [r[last:] for r in rows]
            if len(held[0]) > block:
                hot = (held[0][0], held[1][0])
                yield _overflow(*held)
                held = [h[:0] for h in held]
        yield from close(*held)

    return run


def _link_blocks(radius: int):
    def run(group: pa.Table) -> pa.Table:
        f = group.column("fp").to_numpy()
        ends, roots = stars(f, radius)
        if not ends:
            return LINK_ARROW.empty_table()
        return pa.Table.from_batches([_links(ends, roots)])

    return run


def covering_links(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """``prints(fp)`` of distinct longs -> links ``(a, b)`` that connect all pairs within the radius.

    Every pair within the radius meets in at least one of the masked tables. Buckets are compared in place;
    a bucket of more than ``block`` fingerprints is cut into blocks by hash, and every pair of blocks is
    compared in a task of its own, so no link is lost and no task holds a whole hot bucket.
    """
    masks = np.array(covering_masks(radius), dtype=np.uint64).view(np.int64).tolist()
    tables = F.explode(
        F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    )
    rows = prints.select("fp", tables.alias("m")).select(
        F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp"
    )
    linked = (
        rows.repartition("t", "key")
        .sortWithinPartitions("t", "key")
        .mapInArrow(_link_sorted(radius, block), LINK_SCHEMA)
    )
    linked = saved(linked, "covering")
    direct = linked.where(F.col("b").isNotNull()).select("a", "b")
    hot = linked.where(F.col("b").isNull()).select("t", "key", F.col("a").alias("fp"))
    blocks = hot.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("n"))
    cut = (
        hot.join(blocks, ["t", "key"])
        .withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select("t", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    )
    spread = cut.groupBy("t", "key", "i", "j").applyInArrow(_link_blocks(radius), LINK_SCHEMA)
    return direct.unionByName(spread.select("a", "b"))


def _grouped(docs: DataFrame, text: str, doc_id: str, width: int, radius: int) -> DataFrame:
    """``doc_id, fp, root, component_id`` per row; ``root`` names the group even where no row has an id."""
    prints = docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), width).alias("fp"))
    prints = saved(prints, "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    reach = connected_components(covering_links(classes.select("fp"), radius))
    rooted = classes.join(reach, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4
) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` (signed long) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` among all rows reachable over links of at most ``radius``
    differing fingerprint bits, itself included. Rows are grouped by fingerprint first, so copies cost one
    entry. Null and empty texts have fingerprint zero and link like any other; a null ``doc_id`` keeps its
    row and never names a component (null if a component has no other); repeated ids keep a row each; an
    empty table gives no rows; further columns are ignored.
    """
    return _grouped(docs, text, doc_id, width, radius).select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4
) -> DataFrame:
    """The input's rows with one document of each near-duplicate group: the one its component is named by.

    Of rows that repeat the same id and fingerprint one stays; a group without any id keeps one row. All
    columns come back as they were, further ones included.
    """
    found = _grouped(docs, text, doc_id, width, radius)
    heads = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("fp").alias("_head_fp"), F.min("doc_id").alias("id"))
        .select(_row_key(F.col("id"), F.col("_head_fp")).alias("_head_key"), "_head_fp")
    )
    keyed = docs.withColumn("_head_fp", fingerprint_column(F.col(text), width))
    keyed = keyed.withColumn("_head_key", _row_key(F.col(doc_id), F.col("_head_fp")))
    kept = keyed.join(heads, ["_head_key", "_head_fp"]).dropDuplicates(["_head_key", "_head_fp"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _row_key(doc_id: Column, fp: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("~"), F.hex(fp)))
