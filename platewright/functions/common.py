"""Small column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2**32)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(*parts: str | Column) -> Column:
    """First 32 bits of md5 over the '|'-joined parts: reproducible in any SQL engine."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash60(*parts: str | Column) -> Column:
    """First 60 bits of the same md5, for moduli beyond 32 bits."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def unit_hash(*parts: str | Column) -> Column:
    """Deterministic uniform in [0, 1)."""
    return hash32(*parts) / F.lit(TWO_32)


def decimal_comma(c: str | Column) -> Column:
    """Text with a decimal comma to double, NULL when it does not parse."""
    return F.replace(F.trim(col(c)), F.lit(","), F.lit(".")).try_cast("double")


def finite(c: str | Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def is_bad_double(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation aggregate, NULL where a side is constant (the built-in raises there)."""
    a, b = col(x), col(y)
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def literal_rows(values: list[dict], schema: str) -> Column:
    """A fixed list of records as one array literal, to be exploded without any join."""
    import json

    return F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")
