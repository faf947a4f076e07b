"""Benchmark decontamination: word windows of test items looked up in training texts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.llm.words import ALNUM, alnum_words, utf8

WINDOW = 13
# Bytes of item text in one broadcast block; a larger benchmark is looked up block after block.
BLOCK_BYTES = 32 << 20
# An odd multiplier for the rolling window hash, and the share rule 20 * hit >= words.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SHARE = 20


class Windows:
    """All windows of a block of items, with the items that hold them."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], list[str]] = {}
        for item, raw in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(raw)]
            n = min(width, len(words))
            for i in range(len(words) - n + 1 if words else 0):
                holders = self.owners.setdefault(tuple(words[i : i + n]), [])
                if item not in holders:
                    holders.append(item)
        self.hashes: dict[int, np.ndarray] = {}
        for n in sorted({len(w) for w in self.owners}):
            rows = np.array([w for w in self.owners if len(w) == n], dtype=np.uint64)
            self.hashes[n] = np.unique(self._hash(rows.T))

    @staticmethod
    def _hash(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1:], dtype=np.uint64)
        for c in columns:
            out = (out ^ c) * MULTIPLIER
            out ^= out >> np.uint64(29)
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.uint64, count=len(words))

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(start, length, items) of each occurrence; an id of 0 is a word that no item has."""
        gap = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, known in self.hashes.items():
            if len(ids) < n:
                continue
            start = np.flatnonzero(gap[n:] == gap[:-n])
            if not len(start):
                continue
            h = self._hash(np.stack([ids[start + k] for k in range(n)]))
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in start[known[at] == h].tolist():
                holders = self.owners.get(tuple(ids[i : i + n].tolist()))
                if holders:
                    yield i, n, holders


def find_hits(raws: list[bytes], windows: Windows) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: number of words, merged hit spans as word offsets [start, end), items that occur."""
    per_text = [windows.ids(alnum_words(r)) for r in raws]
    size = np.array([len(x) for x in per_text])
    # One array for the batch; a 0 between texts keeps windows from running across.
    first = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.zeros(int(first[-1]), dtype=np.uint64)
    for x, at in zip(per_text, first[:-1], strict=True):
        flat[at : at + len(x)] = x
    found = sorted(windows.find(flat), key=lambda x: x[0])
    out = [(int(n), [], set()) for n in size]
    owner = np.searchsorted(first, [x[0] for x in found], side="right") - 1
    for (start, n, items), doc in zip(found, owner.tolist(), strict=True):
        begin = start - int(first[doc])
        spans = out[doc][1]
        if spans and begin <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], begin + n))
        else:
            spans.append((begin, begin + n))
        out[doc][2].update(items)
    return out


def benchmark_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The items as broadcasts of bounded bytes, at least one.

    Read one partition at a time and handed over block by block, so the driver's memory is bounded too.
    """
    sc = items.sparkSession.sparkContext
    blocks, block, used = [], [], 0
    rows = items.where("item_id is not null").select(F.col("item_id").cast("string"), utf8(F.col("text")))
    for item, raw in rows.toLocalIterator():
        if used and used + len(raw) > block_bytes:
            blocks.append(sc.broadcast(block))
            block, used = [], 0
        block.append((item, bytes(raw)))
        used += len(raw)
    return [*blocks, sc.broadcast(block)]


def _look_up(raws: list[bytes], blocks: list[Broadcast], ready: Windows | None, width: int) -> list:
    """Hits of all blocks together; windows of one block are in memory at a time."""
    if ready is not None:
        return find_hits(raws, ready)
    merged = [(0, [], set())] * len(raws)
    for block in blocks:
        found = find_hits(raws, Windows(block.value, width))
        merged = [_join(a, b) for a, b in zip(merged, found, strict=True)]
    return merged


def _join(a, b):
    spans: list[tuple[int, int]] = []
    for s, e in sorted(a[1] + b[1]):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], e))
        else:
            spans.append((s, e))
    return b[0], spans, a[2] | b[2]


HITS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def hits_column(text: Column, blocks: list[Broadcast], width: int = WINDOW) -> Column:
    """struct(n_words, spans, items) of each text against all blocks of items."""

    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = Windows(blocks[0].value, width) if len(blocks) == 1 else None
        for batch in batches:
            merged = _look_up([bytes(r) for r in batch], blocks, ready, width)
            yield pd.DataFrame(
                {
                    "n_words": [m[0] for m in merged],
                    "spans": [[{"start": s, "end": e} for s, e in m[1]] for m in merged],
                    "items": [sorted(m[2]) for m in merged],
                }
            )

    return run(utf8(text))


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WINDOW
) -> DataFrame:
    """``doc_id, n_words, n_hit, items (array), spans, contaminated`` for every row of ``docs``.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Candidate positions come from a hash set of the windows and are verified word for word. Spans are word
    offsets. ``contaminated`` means at least one hit and 20 hits per 20 words or more, i.e. a share of 5 %.
    Null and empty texts have no words and no hits; items without an id or without words are left out;
    repeated items count once by id; an empty benchmark gives no hits; an empty ``docs`` gives no rows;
    further columns are ignored. Row-local: no shuffle, whatever passage is shared by however many texts.
    """
    blocks = benchmark_blocks(items)
    found = docs.select(
        F.col(doc_id).alias("doc_id"), hits_column(F.col(text), blocks, width).alias("h")
    )
    hit = F.aggregate("h.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.col("h.n_words").alias("n_words"), hit.alias("n_hit"), F.col("h.items").alias("items"),
        F.col("h.spans").alias("spans"),
    ).withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (F.lit(SHARE) * n_hit >= n_words)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", width: int = WINDOW
) -> DataFrame:
    """The rows that are not contaminated, all columns as they were; nulls and empty texts stay."""
    blocks = benchmark_blocks(items)
    marked = docs.withColumn("_hits", hits_column(F.col(text), blocks, width))
    hit = F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = marked.where(~is_contaminated(hit, F.col("_hits.n_words")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text with the hit word spans cut out, whatever stands between those words included."""
    if not spans:
        return raw
    plain = raw.translate(ALNUM)
    at, bounds = 0, []
    for w in plain.split():
        at = plain.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : bounds[s][0]])
        last = bounds[e - 1][1]
    return b"".join([*out, raw[last:]])


def cut_passages(docs: DataFrame, items: DataFrame, text: str = "text", width: int = WINDOW) -> DataFrame:
    """The other remedy: every row stays and loses its hit spans; other columns are as they were."""
    blocks = benchmark_blocks(items)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = Windows(blocks[0].value, width) if len(blocks) == 1 else None
        for batch in batches:
            raws = [bytes(r) for r in batch]
            merged = _look_up(raws, blocks, ready, width)
            cut = [remove_spans(r, m[1]) for r, m in zip(raws, merged, strict=True)]
            yield pd.Series([c.decode("utf-8", "replace") for c in cut])

    return docs.withColumn(text, F.when(F.col(text).isNotNull(), run(utf8(F.col(text)))))
