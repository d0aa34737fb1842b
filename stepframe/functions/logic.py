"""Conditions as numbers, conditional values, score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """1 when the condition is true, else 0; a comparison with a missing value gives 0."""
    return F.when(cond, 1).otherwise(0)


def ifn(cond: Column, a, b) -> Column:
    """``a`` when the condition is true, else ``b`` (also when it is missing)."""
    return F.when(cond, F.lit(a)).otherwise(F.lit(b))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, missing when ``b`` is 0 or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def cap(c: Column, most) -> Column:
    """Upper limit; a missing value stays missing."""
    return F.when(c > most, F.lit(most)).otherwise(c)


# Score limits and their names.
BANDS = ((0.9, "Ready"), (0.7, "Review"), (0.5, "Manual review"))
BELOW_BANDS = "Failed"
# The long wording of the same bands, used in reports.
BANDS_LONG = (
    (0.9, "Ready — safe to use"),
    (0.7, "Review recommended"),
    (0.5, "Manual review required"),
)
BELOW_BANDS_LONG = "Conversion failed"


def band(score: Column, bands=BANDS, below: str = BELOW_BANDS) -> Column:
    """Name of the first limit that the score reaches."""
    expr = None
    for limit, text in bands:
        expr = F.when(score >= limit, text) if expr is None else expr.when(score >= limit, text)
    return expr.otherwise(below)
