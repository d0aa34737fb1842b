"""Sorting and key de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bygroup import first_row
from .keys import as_list, orderable, parse, sort_columns
from .spread import has_hot_group, number_copies


def sort(df: DataFrame, keys, where: Column | None = None) -> DataFrame:
    """Global sort, missing values lowest; ``where`` filters before the shuffle.

    Rows with equal keys are ordered by a hash of their other columns. That makes the order
    reproducible and lets the range partitioning cut through a key with very many rows. If one row
    has very many copies they are numbered first, so that they can be cut apart as well.
    """
    if where is not None:
        df = df.where(where)
    names = df.columns
    parsed = parse(keys)
    order = sort_columns(parsed)
    rest = [c for c in df.columns if c not in {k.name for k in parsed}]
    if rest:
        order.append(F.xxhash64(*rest))
    # rows can only be copies of each other where their keys are: other columns are read if a key is hot
    keyed = [k.name for k in parsed]
    if all(orderable(f.dataType) for f in df.schema.fields) and has_hot_group(df, keyed) and has_hot_group(df, names):
        df = number_copies(df, "__copy")
        order.append(F.col("__copy").asc())
    return df.orderBy(*order).select(*names)


def nodupkey(df: DataFrame, by, order_by=None, ties: bool = True) -> DataFrame:
    """First row of every key. ``order_by`` decides which row is first, then all other columns.

    Only one row per key and task is shuffled. The result is keyed, not sorted; add ``sort`` where
    the order matters.
    """
    return first_row(df, [k.name for k in parse(by)], as_list(order_by), ties)
