"""Order keys: ``"a"`` sorts ascending, ``"-a"`` descending, missing values below all others."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Key(NamedTuple):
    name: str
    desc: bool = False


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def parse(order_by: str | Iterable[str] | None) -> list[Key]:
    return [Key(k[1:], True) if k.startswith("-") else Key(k) for k in as_list(order_by)]


def sort_columns(keys: Sequence[Key], reverse: bool = False) -> list[Column]:
    """Sort expressions; a missing value is the smallest value in either direction."""
    return [
        F.col(k.name).desc_nulls_last() if k.desc != reverse else F.col(k.name).asc_nulls_first()
        for k in keys
    ]


def orderable(dt: T.DataType) -> bool:
    if isinstance(dt, T.ArrayType):
        return orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(orderable(f.dataType) for f in dt.fields)
    return not isinstance(dt, (T.MapType, T.VariantType, T.CalendarIntervalType))


def total_order(
    df: DataFrame,
    by: Sequence[str],
    order_by: str | Iterable[str] | None,
    ties: bool = True,
) -> list[Key]:
    """``order_by`` completed by all remaining columns, so that the row order is reproducible.

    Pass ``ties=False`` when ``order_by`` is unique within the group already; the sort then
    compares (and a split group samples) fewer columns.
    """
    keys = [k for k in parse(order_by) if k.name not in by]
    if ties:
        used = set(by) | {k.name for k in keys}
        keys += [
            Key(f.name) for f in df.schema.fields if f.name not in used and orderable(f.dataType)
        ]
    if not keys:
        raise ValueError("a BY-group step needs order_by: a DataFrame has no row order of its own")
    return keys


def same_keys(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """Null-safe equality of all pairs: missing keys match missing keys."""
    cond = None
    for a, b in pairs:
        eq = a.eqNullSafe(b)
        cond = eq if cond is None else cond & eq
    return F.lit(True) if cond is None else cond
