"""Statistics by class, frequency tables, remerge helpers, n-th highest value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import as_list, same_keys
from .selection import exact_quantiles
from .spread import piece_rows

#: quantile statistics and their probability
QUANTILES = {"p25": 0.25, "p50": 0.5, "median": 0.5, "p75": 0.75}

_SIMPLE = {
    "n": lambda c: F.count(c),
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "sum": lambda c: F.sum(c),
    "var": lambda c: F.var_samp(c),
    "cv": lambda c: F.try_divide(F.lit(100) * F.stddev_samp(c), F.avg(c)),
}
STATS = (*_SIMPLE, *QUANTILES)


def means(
    df: DataFrame,
    vars,
    stats: Sequence[str] = ("n", "mean", "std", "min", "max"),
    by=None,
    names: Mapping[str, Sequence[str]] | None = None,
    include_missing: bool = False,
    long: bool = False,
) -> DataFrame:
    """Statistics of ``vars``, overall or for every combination of the ``by`` classes.

    Output columns are ``<var>_<stat>``; ``names={"mean": [...]}`` gives own names per statistic,
    in the order of ``vars``. ``long=True`` gives one row per variable instead. Rows with a missing
    class are left out unless ``include_missing``. Quantiles interpolate linearly between the two
    nearest values.
    """
    vars, by = as_list(vars), as_list(by)
    unknown = [s for s in stats if s not in STATS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}; known: {STATS}")
    if not include_missing:
        for b in by:
            df = df.where(F.col(b).isNotNull())
    named = {s: (names or {}).get(s) or [f"{v}_{s}" for v in vars] for s in stats}
    quantiles = [s for s in stats if s in QUANTILES]
    probs = sorted({QUANTILES[s] for s in quantiles})
    split = bool(quantiles) and df.count() > piece_rows(df.sparkSession)

    aggs = []
    for i, v in enumerate(vars):
        for s in stats:
            if s in QUANTILES:
                if split:
                    continue
                # one value list per variable serves all its quantiles
                at = probs.index(QUANTILES[s])
                expr = F.get(F.percentile(F.col(v), F.array(*[F.lit(p) for p in probs])), F.lit(at))
            else:
                expr = _SIMPLE[s](F.col(v))
            aggs.append(expr.alias(named[s][i]))
    if split:
        q = exact_quantiles(df, vars, probs, by)
        picks = [
            F.col(f"__q_{i}_{probs.index(QUANTILES[s])}").alias(named[s][i])
            for i in range(len(vars))
            for s in quantiles
        ]
        q = q.select(*by, *picks)
        # always from the list of groups: one whose values are all missing has no quantile, but is a group
        out = (df.groupBy(*by) if by else df).agg(*(aggs or [F.count(F.lit(1)).alias("__rows")]))
        right = q.withColumnsRenamed({b: f"__g_{b}" for b in by})
        on = same_keys((F.col(b), F.col(f"__g_{b}")) for b in by)
        out = out.join(right, on, "left").drop(*[f"__g_{b}" for b in by])
    else:
        out = (df.groupBy(*by) if by else df).agg(*aggs)
    out = out.select(*by, *[named[s][i] for i in range(len(vars)) for s in stats])
    if not long:
        return out
    rows = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), *[F.col(named[s][i]).cast("double").alias(s) for s in stats])
            for i, v in enumerate(vars)
        ]
    )
    return out.select(*by, F.inline(rows))


def describe(df: DataFrame, vars) -> DataFrame:
    """count, mean, std, min, quartiles and max, one typed row per variable."""
    stats = ["n", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return means(df, vars, stats, long=True).withColumnRenamed("n", "count")


def freq(
    df: DataFrame,
    cols,
    wide: bool = False,
    values: Sequence | None = None,
    include_missing: bool = False,
) -> DataFrame:
    """Frequency table. One column: value and ``count``; two columns: pairs, or ``wide`` with one
    zero-filled column per value of the second. Pass ``values`` to save the job that lists them."""
    cols = as_list(cols)
    if not include_missing:
        for c in cols:
            df = df.where(F.col(c).isNotNull())
    if not wide:
        return df.groupBy(*cols).count()
    rows, across = cols
    table = df.groupBy(rows).pivot(across, list(values) if values else None).count()
    return table.select(rows, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in table.columns if c != rows])


def into_list(df: DataFrame, col: str, sep: str) -> Column:
    """Distinct values, sorted and joined into one text; a scalar for any later step.

    The text is one value, so it is meant for names and other metadata; for values without such a
    bound take ``df.select(col).distinct()``, which stays a table.
    """
    values = df.select(F.col(col).cast("string").alias("v")).where("v IS NOT NULL").distinct()
    return values.agg(F.array_join(F.array_sort(F.collect_list("v")), sep)).scalar()


def nth_highest(df: DataFrame, col: str, n: int, name: str = "nth_highest") -> DataFrame:
    """The n-th highest *distinct* value as one row; missing when there are fewer."""
    top = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(F.col(col).desc()).limit(n)
    return top.agg(F.when(F.count(F.lit(1)) == n, F.min(col)).alias(name))


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar that later steps can use."""
    return df.agg(F.count(F.lit(1))).scalar()
