"""Statistics as Column expressions: missing is null, a division by zero is null."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def num(x: Column) -> Column:
    """NaN and infinities are missing (M1)."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null (M4)."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def rounded(x: Column, digits: int = 0) -> Column:
    """Half away toward plus infinity."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution by the Abramowitz-Stegun polynomial 7.1.26 (M5)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + x * 0.3275911)
    poly = ((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1.0 + erf) / 2.0).otherwise((1.0 - erf) / 2.0)


def quantile(values: Column, q: float) -> Column:
    """Linear interpolation between order statistics of an array without nulls; null if empty (M2)."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.try_element_at(ordered, low + 1), F.try_element_at(ordered, high + 1)
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def median(values: Column) -> Column:
    return quantile(values, 0.5)


def mad(values: Column, center: Column | None = None) -> Column:
    """Median absolute deviation, scaled to a normal's standard deviation (M3)."""
    middle = median(values) if center is None else center
    return median(F.transform(values, lambda x: F.abs(x - middle))) * 1.4826


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Of columns with fixed weights, skipping nulls; null if none is left (A5)."""
    total = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in pairs), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    return F.try_divide(total, F.nullif(weight, F.lit(0.0)))


def shrunk_mean(value: Column, weight: Column, k: float) -> Column:
    """Aggregate: sum(w v) / (sum(w) + k) over rows with a value and a positive weight; null without any."""
    counts = value.isNotNull() & (weight > 0)
    total = F.sum(F.when(counts, weight))
    return F.when(total > 0, F.sum(F.when(counts, value * weight)) / (total + k))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate; null below three pairs or without variance (M6). ``corr`` raises on constants under ANSI."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 3, F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-18, spread)))


def t_stat(x: Column) -> Column:
    """Aggregate: mean over its standard error, from three values on (M9)."""
    return F.when(F.count(x) >= 3, F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(x).cast("double"))))


def average_rank(order: WindowSpec, ties: WindowSpec) -> Column:
    """Rank with ties at their mean; ``ties`` partitions by the value too."""
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0


def z_cross(x: Column, day: WindowSpec) -> Column:
    """Standardised in its cross-section; null without variance."""
    return F.try_divide(x - F.avg(x).over(day), F.nullif(F.stddev_samp(x).over(day), F.lit(0.0)))
