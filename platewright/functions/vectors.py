"""Array arithmetic as column expressions (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewright.functions.common import col

# Fixed value: single-precision machine epsilon, the floor of a vector norm.
FLOAT32_EPS = 1.1920929e-07


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def scaled_distance(a: str | Column, b: str | Column, sd: str | Column) -> Column:
    """Distance after dividing every dimension by its scale."""
    gap = F.zip_with(col(a), col(b), lambda x, y: x - y)
    z = F.zip_with(gap, col(sd), lambda g, s: g / s)
    return F.sqrt(total(F.transform(z, lambda v: v * v)))


def component_distances(a: str | Column, b: str | Column, n: int, width: int) -> Column:
    """One distance per component slice, as an array."""
    return F.array(
        *[
            distance(F.slice(col(a), c * width + 1, width), F.slice(col(b), c * width + 1, width))
            for c in range(n)
        ]
    )


def l2_normalise(v: str | Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(FLOAT32_EPS))
    return F.transform(col(v), lambda x: x / norm)


def delta(v: str | Column, ref: str | Column, scale: Column) -> Column:
    return F.zip_with(col(v), col(ref), lambda x, r: (x - r) / scale)


def window_delta(v: str | Column, ref: str | Column, target: int, radius: int, length: int) -> Column:
    """Difference to a reference in the +-radius window of a 1-based target, clipped at the ends."""
    lo, hi = max(1, target - radius), min(length, target + radius)
    n = hi - lo + 1
    return delta(F.slice(col(v), lo, n), F.slice(col(ref), lo, n), F.sqrt(F.lit(float(n))))


def rbf(d: Column, lengthscale: Column) -> Column:
    return F.exp(F.lit(-0.5) * d * d / (lengthscale * lengthscale))


def mean_of(k: str | Column) -> Column:
    return total(col(k)) / F.size(col(k))


def mean_pair_product(k: str | Column) -> Column:
    """Mean of k_i k_j over i < j from the first two power sums."""
    s1 = total(col(k))
    s2 = dot(k, k)
    m = F.size(col(k))
    return F.when(m > 1, (s1 * s1 - s2) / (m * (m - 1))).otherwise(0.0)


def combined(k: str | Column, sigma_main: float, sigma_epi: float) -> Column:
    """Additive plus pairwise-interaction similarity."""
    return F.lit(sigma_main**2) * mean_of(k) + F.lit(sigma_epi**2) * mean_pair_product(k)
