"""Numeric functions and row-wise statistics over a list of columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def int_(c: Column) -> Column:
    """Integer part, towards zero."""
    return c.cast("bigint")


def idiv(a: Column, b: Column) -> Column:
    """Integer division towards zero; missing when the divisor is 0."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0)))


def fdiv(a: Column, b: Column) -> Column:
    """Real division; missing when the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def row_sum(cols: Iterable) -> Column:
    """Sum over columns of one row, missing values ignored; missing when all are."""
    cs = [_col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cs])
    return F.when(F.coalesce(*cs).isNotNull(), total)


def row_mean(cols: Iterable) -> Column:
    """Mean over columns of one row, missing values ignored; missing when all are."""
    cs = [_col(c) for c in cols]
    present = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cs])
    return F.try_divide(row_sum(cs).cast("double"), present)
