"""Normal-distribution expressions (no engine built-in exists for erf)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewright.functions.common import col

# Two-sided normal multiples of the reported interval levels; one SD stands for 68 %.
Z_LEVELS = {
    "50%": (0.50, 0.67448975),
    "68%": (0.68, 1.0),
    "90%": (0.90, 1.64485363),
    "95%": (0.95, 1.95996398),
}
Z95 = 1.95996398

# Abramowitz & Stegun 26.2.17 coefficients for the normal CDF.
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def upper_tail(z: str | Column) -> Column:
    """P(Z > |z|), absolute error below 7.5e-8."""
    a = F.abs(col(z))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * a)
    poly = F.lit(AS_B[4])
    for b in reversed(AS_B[:4]):
        poly = poly * t + F.lit(b)
    return F.exp(-a * a / F.lit(2.0)) / F.sqrt(F.lit(2.0) * F.pi()) * poly * t


def two_sided_p(z: str | Column) -> Column:
    return F.least(F.lit(1.0), F.lit(2.0) * upper_tail(z))


def upper_tail_sql(z: str) -> str:
    """The same polynomial as SQL text."""
    t = f"(1.0/(1.0+{AS_P!r}*abs({z})))"
    poly = repr(AS_B[4])
    for b in reversed(AS_B[:4]):
        poly = f"({poly}*{t}+({b!r}))"
    return f"(exp(-({z})*({z})/2.0)/sqrt(2.0*pi())*{poly}*{t})"


def gaussian_nlpd(y: str | Column, mean: str | Column, sd: str | Column) -> Column:
    """Per-row negative log predictive density with the SD floored at 1e-9."""
    s = F.greatest(col(sd), F.lit(1e-9))
    r = (col(y) - col(mean)) / s
    return F.lit(0.5) * F.log(F.lit(2.0) * F.pi() * s * s) + F.lit(0.5) * r * r


def quantile_levels(n: int = 18, low: float = 0.1, high: float = 0.95) -> list[tuple[float, float]]:
    """Equally spaced nominal coverage levels with their two-sided z."""
    from statistics import NormalDist

    step = (high - low) / (n - 1)
    out = []
    for i in range(n):
        p = round(low + i * step, 6)
        out.append((p, round(NormalDist().inv_cdf(0.5 + p / 2), 8)))
    return out
