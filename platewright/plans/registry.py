"""Registered queries: a Spark callable and, where one exists, the same result as SQL.

Doubles are rounded on both sides because engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.plans.views import sql_views

DIGITS = 6
# Fixed value: moves exact decimal ties off the rounding edge, the same way in both engines.
NUDGE = 1.3e-10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles, widen ints to bigint and render arrays as text, for a stable comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(
    name: str, sql: str | None = None, doubles: str = "", ints: str = "", digits: int = DIGITS
):
    """Register ``fn(spark, sf_dir)``; ``sql`` may refer to the example views by name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            fixes = [f"round({d} + {NUDGE}, {digits}) + 0.0 AS {d}" for d in doubles.split()]
            fixes += [f"{i}::BIGINT AS {i}" for i in ints.split()]
            star = f"* REPLACE ({', '.join(fixes)})" if fixes else "*"
            body = sql.strip()
            prefix = sql_views(body)
            if prefix and body.upper().startswith("WITH "):
                inner = f"{prefix}, {body[5:]}"
            else:
                inner = f"{prefix} {body}"
            ORACLES[name] = f"SELECT {star} FROM ({inner}) AS answer"
        return fn

    return register
