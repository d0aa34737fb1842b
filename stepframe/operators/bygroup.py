"""BY-group steps: counters, totals, first / last / n-th / top rows, ranks, remerged summaries.

Every step that keeps a bounded number of rows per group is written as ``row_number() <= n`` so
that Spark prunes each task's rows *before* the shuffle (WindowGroupLimit): a hot key sends at most
n rows per task. Steps that keep all rows go through ``ordered`` and its split groups.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .keys import as_list, parse, same_keys, sort_columns, total_order
from .spread import has_hot_group

_NO = "__no"
#: Spark prunes ``row_number() <= n`` before the shuffle up to this n (its default setting)
_PRUNED = 1_000


def by_counter(df: DataFrame, by, order_by, name: str = "count", ties: bool = True) -> DataFrame:
    """Counter that restarts at 1 with every group."""
    return ordered.row_number(df, by, order_by, name, ties)


def _limited(df: DataFrame, by, order_by, n: int, ties: bool, reverse: bool = False) -> DataFrame:
    by = as_list(by)
    keys = total_order(df, by, order_by, ties)
    if n > _PRUNED and not reverse:
        return ordered.row_number(df, by, order_by, _NO, ties).where(F.col(_NO) <= n)
    w = Window.partitionBy(*by).orderBy(*sort_columns(keys, reverse))
    return df.withColumn(_NO, F.row_number().over(w)).where(F.col(_NO) <= n)


def top_n(df: DataFrame, by, order_by, n: int, name: str | None = None, ties: bool = True) -> DataFrame:
    """First ``n`` rows of each group in the given order; ``name`` keeps the rank."""
    out = _limited(df, by, order_by, n, ties)
    if name is None:
        return out.drop(_NO)
    return out.withColumn(name, F.col(_NO).cast("bigint")).drop(_NO)


def nth_row(df: DataFrame, by, order_by, n: int, ties: bool = True) -> DataFrame:
    """Row ``n`` of each group; groups with fewer rows give none."""
    return _limited(df, by, order_by, n, ties).where(F.col(_NO) == n).drop(_NO)


def first_row(df: DataFrame, by, order_by, ties: bool = True) -> DataFrame:
    return _limited(df, by, order_by, 1, ties).drop(_NO)


def last_row(df: DataFrame, by, order_by, ties: bool = True) -> DataFrame:
    """Last whole row of each group, missing values included."""
    return _limited(df, by, order_by, 1, ties, reverse=True).drop(_NO)


def third_or_second(df: DataFrame, by, order_by, ties: bool = True) -> DataFrame:
    """Row 3 of each group, or row 2 when the group has exactly two rows."""
    by = as_list(by)
    top = _limited(df, by, order_by, 3, ties)
    size = F.max(_NO).over(Window.partitionBy(*by))  # at most 3 rows per group are left here
    return (
        top.withColumn("__size", size)
        .where((F.col(_NO) == 3) | ((F.col(_NO) == 2) & (F.col("__size") == 2)))
        .drop(_NO, "__size")
    )


def by_total(
    df: DataFrame,
    by,
    order_by,
    totals: Mapping[str, Column],
    ties: bool = True,
) -> DataFrame:
    """Last row of each group plus group totals: a running sum kept at the last row.

    No running window is needed. The last row comes from a pruned row-number filter, the totals
    from a partial aggregate; both have one row per group and meet in an equi-join.
    """
    by = as_list(by)
    last = last_row(df, by, order_by, ties)
    sums = df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    return _join_back(last.drop(*totals), sums, by, list(totals))


def nested_by_outer(df: DataFrame, outer, inner, order_by, name: str = "count", ties: bool = True) -> DataFrame:
    """Counter reset only where outer and inner key both start, last row of the outer key kept."""
    order = as_list(inner) + as_list(order_by)
    return by_total(df, outer, order, {name: F.count(F.lit(1))}, ties)


def nested_by_inner(df: DataFrame, outer, inner, order_by, name: str = "count", ties: bool = True) -> DataFrame:
    """Counter and last row per (outer, inner) pair."""
    return by_total(df, as_list(outer) + as_list(inner), order_by, {name: F.count(F.lit(1))}, ties)


def _join_back(rows: DataFrame, groups: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Add per-group values to rows; missing keys match. One group row, so no row multiplies."""
    right = groups.withColumnsRenamed({b: f"__g_{b}" for b in by})
    on = same_keys((F.col(b), F.col(f"__g_{b}")) for b in by)
    return rows.join(right, on, "inner").select(*rows.columns, *names)


def remerge(df: DataFrame, by, aggs: Mapping[str, Column]) -> DataFrame:
    """Summary values next to every detail row.

    Without keys the one-row summary is a scalar subquery. With keys: partial aggregate, then an
    equi-join back. The detail side of that join may be skewed; adaptive execution splits it, which
    a window over the whole partition could not.
    """
    by = as_list(by)
    if not by:
        summary = df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("s")).scalar()
        return df.withColumn("__s", summary).select("*", *[F.col("__s")[n].alias(n) for n in aggs]).drop("__s")
    groups = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return _join_back(df, groups, by, list(aggs))


def _rank(df: DataFrame, by, col: str, name: str, desc: bool, inclusive: bool) -> DataFrame:
    by = as_list(by)
    key = parse(f"-{col}" if desc else col)
    plain = bool(by) and not has_hot_group(df, by)
    if plain:
        w = Window.partitionBy(*by).orderBy(*sort_columns(key))
        if inclusive:
            upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            return df.withColumn(name, F.count(col).over(upto).cast("bigint"))
        return df.withColumn(name, F.rank().over(w).cast("bigint"))
    # hot groups: count per distinct value first, then run over the values in split pieces
    counted = F.count(col) if inclusive else F.count(F.lit(1))
    values = df.groupBy(*by, col).agg(counted.alias("__n"))
    order = f"-{col}" if desc else col
    run = ordered.running_sum(values, "__n", by, [order], "__run", ties=False)
    rank = F.col("__run") if inclusive else F.col("__run") - F.col("__n") + 1
    keyed = run.select(*by, col, rank.cast("bigint").alias(name))
    return _join_back(df, keyed, [*by, col], [name])


def count_ge(df: DataFrame, by, col: str, name: str = "rank") -> DataFrame:
    """Rows of the group whose value is at or above this one: ties get the *largest* position."""
    return _rank(df, by, col, name, desc=True, inclusive=True)


def rank_min(df: DataFrame, by, col: str, name: str = "rank", desc: bool = True) -> DataFrame:
    """Competition rank: ties get the *smallest* position."""
    return _rank(df, by, col, name, desc=desc, inclusive=False)


def dedupe_first(df: DataFrame, key, order_by, ties: bool = True) -> DataFrame:
    """First-seen row of every key."""
    return first_row(df, key, order_by, ties)
