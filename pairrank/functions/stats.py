"""Numeric column expressions: ranking discounts, the normal tail, number formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1.0


def position_exposure(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def ideal_dcg(grade_counts: dict[int, Column], k: int) -> Column:
    """DCG of the best possible order, from the count of each grade alone.

    Position p holds the highest grade whose cumulative count reaches p, so the
    ideal order never has to be sorted.
    """
    total = F.lit(0.0)
    grades = sorted((g for g in grade_counts if g > 0), reverse=True)
    for p in range(1, k + 1):
        best = F.lit(0.0)
        for g in sorted(grades):
            reached = sum((grade_counts[h] for h in grades if h >= g), F.lit(0))
            best = F.when(reached >= p, F.lit(float(2**g - 1))).otherwise(best)
        total = total + best / F.lit(math.log2(p + 1))
    return total


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 with ordinary folds.

    Below 2.5 the all-positive series of erf (no cancellation); above it the
    continued fraction of the tail, so small p-values keep their digits.
    """
    xx = x * x
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.cast("double").alias("term"), x.cast("double").alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * 2.0 * xx / (2.0 * n + 1.0)).alias("term"),
            (acc["total"] + acc["term"] * 2.0 * xx / (2.0 * n + 1.0)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    near = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-xx) * series
    fraction = F.aggregate(
        F.sequence(F.lit(120), F.lit(1), F.lit(-1)),
        F.lit(1.0),
        lambda acc, n: F.lit(1.0) + (n / (2.0 * xx)) / acc,
    )
    far = F.exp(-xx) / (x * F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(x < 2.5, near).otherwise(far)


def two_proportion_p(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """Two-sided pooled z-test; null where it is undefined."""
    defined = (n_a > 0) & (n_b > 0)
    pooled = (hits_a + hits_b) / F.nullif(n_a + n_b, F.lit(0))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(n_a, F.lit(0)) + 1 / F.nullif(n_b, F.lit(0))))
    z = (hits_a / F.nullif(n_a, F.lit(0)) - hits_b / F.nullif(n_b, F.lit(0))) / F.nullif(error, F.lit(0.0))
    return F.when(defined & (pooled > 0) & (pooled < 1), erfc(F.abs(z) / F.lit(math.sqrt(2.0))))


def bonferroni(n_groups: Column, alpha: float = 0.05) -> Column:
    return F.lit(alpha) / comparisons(n_groups)


def comparisons(n_groups: Column) -> Column:
    return F.greatest(F.lit(1), (n_groups * (n_groups - 1) / 2).cast("int"))


def fixed(value: Column, places: int) -> Column:
    """Fixed-point text, halves to even on the exact binary value."""
    pattern = "0" if places == 0 else "0." + "0" * places
    return F.call_function("format_number", value, F.lit(pattern))


def round6(column: Column) -> Column:
    return F.round(column, 6)
