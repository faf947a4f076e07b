"""Hash-index resamples counted draw by draw: no row is made, sent or kept per draw and slot.

Slot i of draw d takes the row at place hash(d, i) mod n. A task takes whole draws: it counts how often each place is picked
and reads the rows of the written table against the counts, so what it sends on is one number per draw and statistic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs

from platewright.functions.digests import Numbered, prefixed_digests

# Texts hashed at a time; their working arrays stay in a core's cache.
STEP = 32768
# Ranges of fewer slots are hashed for several draws in one call.
SHORT = 2048
# Picks that one task counts; a task of a large table takes MIN_DRAWS all the same, as it reads the table first.
TASK_PICKS = 100_000_000
MIN_DRAWS = 16
# Rows of a draw whose ranks are worked on at a time, times DRAWS_AT_ONCE; the arrays stay in a core's cache.
PIECE = 32768
# Draws whose ranks are made together: the counts of a row lie side by side, so a row in any order is one access.
DRAWS_AT_ONCE = 8
# Bytes of counts and ranks of the draws made together.
HELD_BYTES = 256 << 20


def draw_tasks(rows: int, draws: int, least: int) -> int:
    """Tasks over the draws: about ``TASK_PICKS`` picks each, ``least`` at least."""
    each = max(MIN_DRAWS, TASK_PICKS // max(1, rows))
    return max(1, min(draws, max(least, -(-draws // each))))


def batches_of(files: list[str], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of written Parquet files, read by the task itself."""
    for file in files:
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=rows, columns=columns, use_threads=False)


def _steps(size: int) -> Iterator[tuple[int, int]]:
    """Ranges of slots of one length in digits, ``STEP`` at most."""
    low = 0
    while low < size:
        high = min(size, low + STEP, 10 ** len(str(low)))
        yield low, high
        low = high


def _hashes(draws: list[int], low: int, high: int) -> Iterator[np.ndarray]:
    """For every draw the 60-bit hashes of its slots ``low`` up to ``high - 1``."""
    if high - low >= SHORT:
        texts = Numbered(low, high)
        yield from (texts.hash60(draw) for draw in draws)
        return
    many = STEP // (high - low)
    for at in range(0, len(draws), many):
        first, second = prefixed_digests(draws[at : at + many], range(low, high))[:2].astype(np.int64)
        yield from first << 28 | second >> 4


def count_picks(draws: list[int], first: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often every draw picks every row, shape (draws, rows); groups of ``total`` rows start at row ``first``.

    Two bytes a row and draw: that one row is picked 65,536 times by one draw of a hash does not happen.
    """
    counts = np.zeros((len(draws), int(total.sum())), dtype=np.uint16)
    largest = np.argsort(-total, kind="stable")
    one = np.uint16(1)
    for low, high in _steps(int(total.max(initial=0))):
        reached = largest[: np.searchsorted(-total[largest], -low, side="left")]
        for line, found in zip(counts, _hashes(draws, low, high), strict=True):
            for g in reached:
                n = int(total[g])
                part = found[: n - low]
                np.add.at(line, part - part // n * n + int(first[g]), one)
    return counts


class Orders:
    """The order of all rows by every measure, with the bounds of its tie runs; a missing value is in no order."""

    def __init__(self, ranks: np.ndarray):
        """``ranks`` has a line per measure: twice the tie-averaged rank of every row, zero for a missing value."""
        self.rows = ranks.shape[1]
        self.present, self.order, self.bounds = ranks > 0, [], []
        for line in ranks:
            order = np.argsort(line).astype(np.int32)[np.count_nonzero(line == 0) :]
            placed = line[order]
            starts = np.flatnonzero(np.append(True, placed[1:] != placed[:-1])[: len(order)])
            self.order.append(order)
            self.bounds.append(np.append(starts, len(order)).astype(np.int32))

    def _ranked(self, measure: int, taken: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows in order of the measure with, a line per draw, their counts and twice their tie-averaged ranks in the draw.

        Counts and ranks lie in ``room``, two arrays that the next piece overwrites.
        """
        order, bounds = self.order[measure], self.bounds[measure]
        most = np.int32(room.shape[2])
        before = np.zeros((taken.shape[1], 1))
        run, runs = 0, len(bounds) - 1
        while run < runs:
            low = bounds[run]
            last = max(run + 1, int(np.searchsorted(bounds, low + most, side="right")) - 1)
            high = bounds[last]
            if high - low > most:
                pieces = [order[at : min(high, at + most)] for at in range(low, high, most)]
                ties = sum(taken.take(rows, axis=0).sum(axis=0, dtype=float) for rows in pieces)[:, None]
                for rows in pieces:
                    w, rank = room[:2, :, : len(rows)]
                    np.copyto(w, taken.take(rows, axis=0).T)
                    np.copyto(rank, 2 * before + ties + 1)
                    yield rows, w, rank
                before = before + ties
            else:
                rows = order[low:high]
                w, rank = room[:2, :, : len(rows)]
                np.copyto(w, taken.take(rows, axis=0).T)
                np.cumsum(w, axis=1, out=rank)
                rank += before
                before = rank[:, -1:].copy()
                starts, sizes = bounds[run:last] - low, np.diff(bounds[run : last + 1])
                tied = np.flatnonzero(sizes > 1)
                starts, sizes = starts[tied], sizes[tied]
                shared = rank[:, starts] - w[:, starts] + rank[:, starts + sizes - 1] + 1
                rank *= 2
                rank -= w
                rank += 1
                if len(tied):
                    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    rank[:, np.repeat(starts, sizes) + inside] = np.repeat(shared, sizes, axis=1)
                yield rows, w, rank
            run = last

    def correlations(self, taken: np.ndarray) -> np.ndarray:
        """Spearman correlation of measure 0 with every other one in every draw, shape (draws, measures - 1); NaN if constant.

        ``taken`` has the counts of a row side by side, shape (rows, draws). Ranks are those among the drawn rows with
        a value, as for a table that holds a row once per pick; a correlation is that of rows with both values.
        """
        middle = float(self.rows + 1)
        room = np.empty((5, taken.shape[1], max(1, PIECE // taken.shape[1])))
        truth = np.zeros(taken.shape, dtype=np.int32)
        for rows, _, rank in self._ranked(0, taken, room):
            truth[rows] = rank.T
        whole = self.present[0].all()
        out = []
        for measure in range(1, len(self.order)):
            sums = np.zeros((6, taken.shape[1]))
            for rows, w, y in self._ranked(measure, taken, room):
                x, wx, wy = room[2:, :, : len(rows)]
                if not whole:
                    w *= self.present[0, rows]
                np.copyto(x, truth.take(rows, axis=0).T)
                x -= middle
                y -= middle
                np.multiply(w, x, out=wx)
                np.multiply(w, y, out=wy)
                products = [np.vecdot(*pair) for pair in ((wx, x), (wy, y), (wx, y))]
                sums += [w.sum(axis=1), wx.sum(axis=1), wy.sum(axis=1), *products]
            n, sx, sy, sxx, syy, sxy = sums
            spread = np.sqrt(np.maximum(n * sxx - sx * sx, 0)) * np.sqrt(np.maximum(n * syy - sy * sy, 0))
            out.append(np.divide(n * sxy - sx * sy, spread, out=np.full(len(n), np.nan), where=spread > 0))
        return np.stack(out, axis=1)
