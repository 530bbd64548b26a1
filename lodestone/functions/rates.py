"""Ratios that stay null where nothing was assessed, and score intervals."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1_strict(p: Column, r: Column) -> Column:
    """Null where precision or recall is, or both are 0."""
    return ratio(2 * p * r, p + r)


def f1_dice(tp: Column, fp: Column, fn: Column) -> Column:
    """From pooled counts: 0 where nothing was right; null only without any count."""
    return ratio(2 * tp, 2 * tp + fp + fn)


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> Column:
    """(low, high) of a share; null at n = 0; closed at 0 and 1 for no or only successes."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    share = successes / F.nullif(n.cast("double"), F.lit(0.0))
    middle, spread = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4.0 * n * n))
    low = F.when(successes == 0, 0.0).otherwise((middle - spread) / (1 + z * z / n))
    high = F.when(successes == n, 1.0).otherwise((middle + spread) / (1 + z * z / n))
    return F.when(n > 0, F.struct(low.alias("low"), high.alias("high")))


def shown(value: Column, digits: int = 3) -> Column:
    """For reports: null as n/a."""
    return F.coalesce(F.format_number(value, digits), F.lit("n/a"))
