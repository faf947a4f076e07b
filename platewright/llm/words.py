"""Word splitting shared by the operators; texts are UTF-8 bytes, so broken text cannot raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates words, and its complement as a pattern.
BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def utf8(text: Column) -> Column:
    """The text's bytes; null becomes empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def blank_words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words between blanks."""
    return raw.lower().split()


def word_count(text: Column) -> Column:
    """Number of words between blanks, JVM-side; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, k: int) -> Column:
    """crc32 of the key as text, modulo k; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(k)


def _letters_and_digits() -> bytes:
    table = bytearray(range(256))
    for c in range(128):
        ch = chr(c)
        table[c] = ord(ch.lower()) if ch.isalnum() else 32
    return bytes(table)


ALNUM = _letters_and_digits()


def alnum_words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters."""
    return raw.translate(ALNUM).split()
