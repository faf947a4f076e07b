"""Fill-in-the-middle by block rotation in place.

Two cuts make three blocks. Sentinels are put before them in a bytearray that then holds prefix, middle, suffix; the
blocks that change places are exchanged by three reversals (either block, then both), which needs no second buffer
and is undone by the same rotation with the blocks' sizes exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.llm.words import utf8

# The sentinels and the contract's shares in hundredths.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
BLOCK = 1 << 16


def _leads(part: np.ndarray) -> np.ndarray:
    """Marks the first byte of every code point."""
    return (part & 0xC0) != 0x80


def code_points(raw: bytes) -> int:
    if raw.isascii():
        return len(raw)
    view = np.frombuffer(raw, dtype=np.uint8)
    return sum(int(np.count_nonzero(_leads(view[i : i + BLOCK]))) for i in range(0, len(view), BLOCK))


def byte_offsets(raw: bytes, places: list[int]) -> list[int]:
    """Byte offset of each of the ascending code point ``places``; one scan in blocks, whatever the length."""
    if raw.isascii():
        return list(places)
    view, out, passed = np.frombuffer(raw, dtype=np.uint8), [], 0
    for i in range(0, len(view), BLOCK):
        if len(out) == len(places):
            break
        at = np.flatnonzero(_leads(view[i : i + BLOCK]))
        while len(out) < len(places) and places[len(out)] < passed + len(at):
            out.append(i + int(at[places[len(out)] - passed]))
        passed += len(at)
    return out + [len(raw)] * (len(places) - len(out))


def _reverse(view: np.ndarray, a: int, b: int) -> None:
    half = (b - a) // 2
    if half:
        low, high = view[a : a + half], view[b - half : b][::-1]
        kept = low.copy()
        low[:] = high
        high[:] = kept


def rotate(buffer: bytearray, a: int, middle: int, b: int) -> None:
    """Exchange the neighbouring blocks [a, middle) and [middle, b) of ``buffer`` in place."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    _reverse(view, a, middle)
    _reverse(view, middle, b)
    _reverse(view, a, b)


def has_sentinel(raw: bytes) -> bool:
    return PREFIX in raw or SUFFIX in raw or MIDDLE in raw


def moved(raw: bytes, first: int, second: int, form: str) -> bytes:
    """The text in ``form``, cut at the byte offsets ``first`` <= ``second``."""
    if form == "plain":
        return raw
    buffer = bytearray(raw)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, 0 if form == "spm" else middle, suffix, len(buffer))
    return bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    """The text from its output and form alone; the sentinels occur nowhere else in it."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    start = 0 if form == "spm" else buffer.index(SUFFIX)
    cut = buffer.index(PREFIX if form == "spm" else MIDDLE)
    rotate(buffer, start, cut, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def _draws(key: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of sha256 over ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


MOVED = "n long, form string, prefix_chars long, middle_chars long, output binary"


def move_middles(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    seed: int = 1,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row; output is UTF-8 bytes.

    Four numbers hashed from the id give the two cuts, in code points of the whole text, and the form: ``psm``, ``spm``
    or ``plain``. Null texts count as empty; empty texts and texts that hold a sentinel are plain. A null id hashes as
    an empty one; repeated rows are cut alike and keep a row each; an empty table gives no rows; further columns
    are ignored. Row-local: memory is a few times the longest text of a batch.
    """

    @F.pandas_udf(MOVED)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for raws, *draws in batches:
            rows = []
            for raw, h1, h2, h3, h4 in zip(raws, *[d.tolist() for d in draws], strict=True):
                raw = bytes(raw)
                n = code_points(raw)
                if not raw or h3 % 100 >= plain_from or has_sentinel(raw):
                    rows.append((n, "plain", None, None, raw))
                    continue
                form = "spm" if h4 % 100 < spm_below else "psm"
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                rows.append((n, form, a, b - a, moved(raw, *byte_offsets(raw, [a, b]), form)))
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    moves = run(utf8(F.col(text)), *_draws(F.col(doc_id), seed))
    return docs.select(F.col(doc_id).alias("doc_id"), moves.alias("m")).select("doc_id", "m.*")


def restored_text(output: Column, form: Column) -> Column:
    """Text bytes of each output and form."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([restored(bytes(o), f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return run(output, form)
