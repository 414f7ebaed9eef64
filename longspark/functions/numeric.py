"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    """Logistic function, stable for large negative arguments."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def finite(x: Column) -> Column:
    """True for a non-null number that is neither NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation aggregate that is null, not an error, when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def dot(columns: list[Column], weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(w) for c, w in zip(columns, weights, strict=True)])


def oriented(metric: Column, control: Column, candidate: Column) -> Column:
    """Gain of the candidate, signed so that positive is better for the metric."""
    from longspark.schema import COVERAGE_TARGET, HIGHER_IS_BETTER, LOWER_IS_BETTER

    def miss(x: Column) -> Column:
        return F.abs(x - F.lit(COVERAGE_TARGET))

    return (
        F.when(metric.isin(*LOWER_IS_BETTER), control - candidate)
        .when(metric.isin(*HIGHER_IS_BETTER), candidate - control)
        .when(metric == "coverage_90", miss(control) - miss(candidate))
    )
