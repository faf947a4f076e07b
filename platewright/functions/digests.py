"""md5 of many short texts at once: the hashes that SQL makes row by row, as arrays inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np

# Texts hashed at a time: the working arrays of a step stay in a core's cache.
STEP = 32768
LONGEST = 55

_SINES = np.array([int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)], dtype=np.uint32)
_WORDS = [(1, 0), (5, 1), (3, 5), (7, 0)]
_WORDS = np.array([(_WORDS[i // 16][0] * i + _WORDS[i // 16][1]) % 16 for i in range(64)])
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
# Arrays without a dimension: numpy takes them faster than its own scalars.
_TURNS = [tuple(np.array(x, dtype=np.uint32) for x in (t, 32 - t)) for i in range(64) for t in [_TURNS[i // 16][i % 4]]]
_FOURS = np.frombuffer(b"".join(b"%04d" % i for i in range(10_000)), dtype=np.uint8).reshape(-1, 4)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

# Working arrays of a step; lines a power of two apart would share their places in the cache.
_ROOM = np.empty((6, STEP + 528), dtype=np.uint32)


def md5_words(texts: np.ndarray) -> np.ndarray:
    """md5 of every row of a byte matrix (texts of one length, 55 bytes at most) as four big-endian words, shape (4, rows)."""
    n, length = texts.shape
    if length > LONGEST:
        raise ValueError(f"texts of {length} bytes, at most {LONGEST} fit one block")
    used = length // 4 + 1
    out = np.empty((4, n), dtype=np.uint32)
    for at in range(0, n, STEP):
        part = texts[at : at + STEP]
        block = np.zeros((len(part), 4 * used), dtype=np.uint8)
        block[:, :length] = part
        block[:, length] = 0x80
        words = np.ascontiguousarray(block.view("<u4").T)
        _digest(dict(enumerate(words)), {14: 8 * length}, out[:, at : at + STEP])
    return out.byteswap(inplace=True)


def _digest(words: dict[int, np.ndarray], fixed: dict[int, int], out: np.ndarray) -> None:
    """The 64 steps of one block for all columns of ``out``, as many of the four digest words as it has rows.

    A word of the block is its array in ``words`` plus its number in ``fixed``, zero where it has none.
    """
    n = out.shape[1]
    a, b, c, d, f, g = _ROOM[:, :n] if n <= STEP else np.empty((6, n), dtype=np.uint32)
    for x, start in zip((a, b, c, d), _START):
        x.fill(start)
    block = np.array([fixed.get(i, 0) for i in range(16)], dtype=np.uint32)
    added = _SINES + block[_WORDS]
    for i, word in enumerate(_WORDS.tolist()):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif kind == 1:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif kind == 2:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.bitwise_not(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(a, f, a)
        np.add(a, added[i, ...], a)
        if word in words:
            np.add(a, words[word], a)
        left, right = _TURNS[i]
        np.left_shift(a, left, g)
        np.right_shift(a, right, a)
        np.bitwise_or(a, g, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    for row, x, start in zip(out, (a, b, c, d), _START):
        np.add(x, np.uint32(start), out=row)


class Numbered:
    """Texts ``|low`` up to ``|high - 1``, numbers of one length, laid out once and hashed behind any prefix."""

    def __init__(self, low: int, high: int):
        size = len(str(low))
        if len(str(high - 1)) != size:
            raise ValueError(f"{low} and {high - 1} differ in length")
        left, fours = np.arange(low, high), -(-size // 4)
        text = np.empty((len(left), 4 * fours), dtype=np.uint8)
        for i in range(fours - 1, 0, -1):
            rest = left // 10_000
            text[:, 4 * i : 4 * i + 4] = _FOURS[left - rest * 10_000]
            left = rest
        text[:, :4] = _FOURS[left]
        self.text, self.words = text[:, 4 * fours - size :], {}

    def _behind(self, filled: int) -> np.ndarray:
        """Words of the texts where the word they start in holds ``filled`` bytes of the prefix."""
        if filled not in self.words:
            n, size = self.text.shape
            block = np.zeros((n, 4 * ((filled + size + 1) // 4 + 1)), dtype=np.uint8)
            block[:, filled] = ord("|")
            block[:, filled + 1 : filled + 1 + size] = self.text
            block[:, filled + 1 + size] = 0x80
            self.words[filled] = np.ascontiguousarray(block.view("<u4").T)
        return self.words[filled]

    def hash60(self, prefix: int) -> np.ndarray:
        """First 60 bits of the md5 of ``prefix|number``."""
        head = str(prefix).encode()
        length = len(head) + 1 + self.text.shape[1]
        if length > LONGEST:
            raise ValueError(f"texts of {length} bytes, at most {LONGEST} fit one block")
        whole, filled = divmod(len(head), 4)
        fixed = dict(enumerate(np.frombuffer(head.ljust(4 * whole + 4, b"\0"), dtype="<u4").tolist()))
        fixed[14] = 8 * length
        words = {whole + i: w for i, w in enumerate(self._behind(filled))}
        out = np.empty((2, len(self.text)), dtype=np.uint32)
        _digest(words, fixed, out)
        high, low = out.byteswap(inplace=True)
        found = high.astype(np.int64)
        found <<= 28
        found |= low >> 4
        return found


def prefixed_digests(prefixes: Iterable, keys: Iterable) -> np.ndarray:
    """md5 of ``prefix|key`` for all pairs as big-endian words, shape (4, prefixes, keys)."""
    heads, tails = ([str(x).encode() for x in xs] for xs in (prefixes, keys))
    out = np.empty((4, len(heads), len(tails)), dtype=np.uint32)
    by_size = list(_by_length(tails))
    for lines, head in _by_length(heads):
        for rows, tail in by_size:
            width = head.shape[1] + 1 + tail.shape[1]
            if width > LONGEST:
                for i in lines:
                    raw = b"".join(md5(heads[i] + b"|" + tails[j]).digest() for j in rows)
                    out[:, i, rows] = np.frombuffer(raw, dtype=">u4").reshape(-1, 4).T
                continue
            step = max(1, STEP // len(rows))
            for lo in range(0, len(lines), step):
                some = lines[lo : lo + step]
                text = np.empty((len(some), len(rows), width), dtype=np.uint8)
                text[:, :, : head.shape[1]] = head[lo : lo + step, None]
                text[:, :, head.shape[1]] = ord("|")
                text[:, :, head.shape[1] + 1 :] = tail
                out[:, some[:, None], rows] = md5_words(text.reshape(-1, width)).reshape(4, len(some), len(rows))
    return out


def _by_length(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and byte matrix of the texts of every length."""
    lengths = np.array([len(t) for t in texts])
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, np.frombuffer(b"".join(texts[i] for i in at), dtype=np.uint8).reshape(len(at), size)
