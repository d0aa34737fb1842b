"""Exact quantiles of large groups by counting.

A quantile lies between two ranks. Each round narrows the interval of values that holds both: a mergeable sketch
proposes its ends, and one aggregate counts exactly what lies below, at and between them. A rank that falls on an end is
found, whatever the number of copies that the end has; only values between the ends go on to the next round, less than
one in ``GRID / 8``, until they are few enough to be listed per group. So hot groups and ties cost no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .keys import same_keys
from .spread import piece_rows

#: points of the sketch at equal shares of the rows, and its accuracy (an error of 1 / ACCURACY of the rows)
GRID, ACCURACY = 1000, 10_000
#: ranks by which an interval is widened, for the sketch's rounding in small groups
SLACK = 2


def exact_quantiles(df: DataFrame, vars: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Quantiles of ``vars`` that interpolate linearly, per group of ``by``: ``__q_<variable no>_<probability no>``.

    Equal to ``percentile`` but without a list of all values of a group, a sort or a numbering. Two reads of the input
    for the first round and one for the second; starts jobs.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("__var"), F.col(v).cast("double").alias("__x")) for i, v in enumerate(vars)])
    values = df.select(*by, F.inline(pairs)).where(F.col("__x").isNotNull())
    groups = [*by, "__var"]
    spot = lambda p: (F.col("__m") - 1) * F.lit(float(p))
    wanted = F.inline(F.array(*[F.struct(F.lit(j).alias("__q"), spot(p).alias("__at")) for j, p in enumerate(probs)]))
    sizes = values.groupBy(*groups).agg(F.count(F.lit(1)).alias("__m"))
    unknown = F.lit(None).cast("double")
    state = sizes.select(*groups, "__m", wanted).withColumns({"__k1": F.floor("__at") + 1, "__k2": F.ceil("__at") + 1, "__a": unknown, "__b": unknown})
    state = _stored(state)
    limit = max(piece_rows(df.sparkSession), 8 * SLACK)
    cell, on, ended = [*groups, "__q"], groups, []
    while (state.agg(F.max("__m")).first()[0] or 0) > limit:
        state, values = _narrow(values, state, on, cell)
        known = F.col("__a").isNotNull() & F.col("__b").isNotNull()
        ended.append(state.where(known).select(*cell, "__at", "__a", "__b"))
        state, on = state.where(~known), cell
    # what is left of a group fits in one list
    lists = values.groupBy(*on).agg(F.sort_array(F.collect_list("__x")).alias("__xs"))
    pick = lambda known, k: F.coalesce(known, F.get("__xs", (F.col(k) - 1).cast("int"))).alias(known)
    found = _beside(state, lists, on).select(*cell, "__at", pick("__a", "__k1"), pick("__b", "__k2"))
    for part in ended:
        found = found.unionByName(part)
    low, high = F.floor("__at"), F.ceil("__at")
    value = F.when(F.col("__a").eqNullSafe(F.col("__b")), F.col("__a")).otherwise((high - F.col("__at")) * F.col("__a") + (F.col("__at") - low) * F.col("__b"))
    cells = [F.max(F.when((F.col("__var") == i) & (F.col("__q") == j), value)).alias(f"__q_{i}_{j}") for i in range(len(vars)) for j in range(len(probs))]
    return (found.groupBy(*by) if by else found).agg(*cells)


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "selection")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _beside(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on ``on``; missing keys match."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    return left.join(right, same_keys((F.col(c), F.col(f"__r_{c}")) for c in on)).drop(*[f"__r_{c}" for c in on])


def _narrow(values: DataFrame, state: DataFrame, on: Sequence[str], cell: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The state with found values, sizes and ranks between the ends; and the values between them, per ``cell``."""
    grid = F.percentile_approx("__x", [i / GRID for i in range(GRID + 1)], ACCURACY)
    sketch = values.groupBy(*on).agg(grid.alias("__grid"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    at = lambda k, slack: (F.col(k) + F.lit(slack)) * F.lit(float(GRID)) / F.col("__m")
    first, last = F.floor(at("__k1", -SLACK)) - 1, F.ceil(at("__k2", SLACK)) + 1
    ends = {
        "__lo": F.when(first > 0, F.get("__grid", first.cast("int"))).otherwise(F.col("__min")),
        "__hi": F.when(last < GRID, F.get("__grid", last.cast("int"))).otherwise(F.col("__max")),
    }
    cut = _stored(_beside(state, sketch, on).withColumns(ends).drop("__grid", "__min", "__max"))
    x, lo, hi = F.col("__x"), F.col("__lo"), F.col("__hi")
    met = _beside(values, cut.select(*cell, "__lo", "__hi"), on)
    count = lambda test, name: F.sum(test.cast("long")).alias(name)
    counts = met.groupBy(*cell).agg(count(x < lo, "__below"), count(x <= lo, "__upto"), count(x >= hi, "__from"), count(x > hi, "__above"))
    both = _beside(cut, counts, cell)
    # an end that the exact counts prove wrong is dropped: then the interval is open on that side
    both = both.withColumns({"__lo": F.when(F.col("__below") < F.col("__k1"), lo), "__hi": F.when(F.col("__k2") <= F.col("__m") - F.col("__above"), hi)})
    less = F.when(lo.isNotNull(), F.col("__upto")).otherwise(0)
    more = F.when(hi.isNotNull(), F.col("__from")).otherwise(0)
    value = lambda k: F.when(F.col(k) <= less, lo).when(F.col(k) > F.col("__m") - more, hi)
    both = both.withColumns({"__a": F.coalesce("__a", value("__k1")), "__b": F.coalesce("__b", value("__k2")), "__less": less, "__m": F.col("__m") - less - more})
    # a rank that is found follows the other one
    k1 = F.when(F.col("__a").isNull(), F.col("__k1")).otherwise(F.col("__k2")) - F.col("__less")
    k2 = F.when(F.col("__b").isNull(), F.col("__k2")).otherwise(F.col("__k1")) - F.col("__less")
    known = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    size = F.when(known, 0).otherwise(F.col("__m"))
    state = _stored(both.select(*cell, "__at", k1.alias("__k1"), k2.alias("__k2"), size.alias("__m"), "__a", "__b", "__lo", "__hi"))
    going = state.where(~known).select(*cell, "__lo", "__hi")
    inside = (lo.isNull() | (x > lo)) & (hi.isNull() | (x < hi))
    return state.drop("__lo", "__hi"), _stored(_beside(values, going, on).where(inside).select(*cell, "__x"))
