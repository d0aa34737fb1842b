"""Row numbers, running totals and row offsets in an explicit order, with or without BY keys."""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .keys import Key, as_list, parse, same_keys, sort_columns, total_order
from .spread import Spread

#: farthest offset served from the edges of a piece; beyond it rows are joined by number
_NEAR = 100


def row_number(
    df: DataFrame,
    by: str | Iterable[str] | None,
    order_by,
    name: str = "row_no",
    ties: bool = True,
) -> DataFrame:
    """Dense 1-based row number within ``by`` (over the whole table when ``by`` is empty)."""
    by = as_list(by)
    sp = Spread(df, by, total_order(df, by, order_by, ties))
    local = F.row_number().over(sp.window()).cast("bigint")
    if not sp.split:
        return sp.finish(df.withColumn(name, local), name)
    out = sp.attach(sp.carry(__before=F.count(F.lit(1))))
    return sp.finish(out.withColumn(name, local + F.coalesce("__before", F.lit(0))), name)


def row_index(df: DataFrame, order_by, name: str = "row_num", ties: bool = True) -> DataFrame:
    """Row number over the whole table without bringing the table into one task."""
    return row_number(df, None, order_by, name, ties)


#: a double is added up as three integers of so many bits each, on one scale for the column
_LIMB_BITS = 28
_LIMBS = 3


def _exact_parts(df: DataFrame, col: str) -> tuple[dict[str, Column], Callable[[Mapping[str, Column]], Column]]:
    """Integers whose sums do not depend on the order of the rows, and how to get a total back from their sums.

    The scale is the power of two above the column's largest value, found by one aggregate inside the same plan. 84 bits
    below it are kept, so values are taken as they are unless they are 2 ** 31 times smaller than the largest one, and the total
    is the exact sum, rounded once. Infinite values and NaN are added apart, by their own rules.
    """
    finite = F.when(~F.isnan(col) & (F.abs(F.col(col)) < float("inf")), F.col(col).cast("double"))
    top = df.agg(F.max(F.abs(finite)).alias("top")).select(F.greatest(F.coalesce(F.ceil(F.log2(F.nullif("top", F.lit(0.0)))), F.lit(0)), F.lit(-995)).alias("e")).scalar()
    unit = F.lit(float(1 << _LIMB_BITS))
    parts: dict[str, Column] = {}
    rest = F.coalesce(finite, F.lit(0.0)) * F.pow(F.lit(2.0), F.lit(_LIMB_BITS) - top)
    for k in range(_LIMBS):
        whole = F.rint(rest) if k == _LIMBS - 1 else F.floor(rest)
        parts[f"__limb{k}"] = F.when(F.col(col).isNotNull(), whole.cast("bigint"))
        rest = (rest - whole.cast("double")) * unit
    parts["__odd"] = F.when(F.col(col).isNotNull(), F.when(finite.isNull(), F.col(col).cast("double")).otherwise(0.0))

    def total(sums: Mapping[str, Column]) -> Column:
        whole = F.lit(0).cast("decimal(38,0)")
        for k in range(_LIMBS):
            shift = F.lit(1 << _LIMB_BITS * (_LIMBS - 1 - k)).cast("decimal(18,0)")
            whole = (whole + (sums[f"__limb{k}"].cast("decimal(20,0)") * shift).cast("decimal(38,0)")).cast("decimal(38,0)")
        low = top - _LIMB_BITS * _LIMBS
        half = F.floor(low / 2)  # in two steps: the power itself may be too small for a double
        return whole.cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), low - half) + sums["__odd"]

    return parts, total


def running_sum(
    df: DataFrame,
    col: str,
    by: str | Iterable[str] | None,
    order_by,
    name: str | None = None,
    ties: bool = True,
) -> DataFrame:
    """Running total; a missing value adds nothing.

    Within BY groups the first row *assigns* its value, so leading missing values stay missing.
    Over the whole table the retained variable starts at 0. Totals of doubles are exact sums, rounded once: they do not
    depend on how groups are cut into pieces or on the number of tasks.
    """
    by = as_list(by)
    name = name or f"{col}_running"
    sp = Spread(df, by, total_order(df, by, order_by, ties))
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        parts, total = _exact_parts(df, col)
    else:
        parts, total = {"__value": F.col(col)}, lambda sums: sums["__value"]
    for part, value in parts.items():
        sp.add(part, value)
    out = sp.attach(sp.carry(**{f"{p}_before": F.sum(p) for p in parts})) if sp.split else sp.frame
    out = out.withColumns({f"{p}_sum": F.sum(p).over(sp.rows_so_far()) for p in parts})
    sums = {p: F.col(f"{p}_sum") for p in parts}
    if sp.split:
        some = F.coalesce(*[f"{p}_{x}" for p in parts for x in ("sum", "before")]).isNotNull()
        sums = {p: F.when(some, F.coalesce(f"{p}_sum", F.lit(0)) + F.coalesce(f"{p}_before", F.lit(0))) for p in parts}
    out = out.withColumn(name, total(sums))
    if not by:
        out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    return sp.finish(out, name)


def _offset(sp: Spread, value: str, n: int, forward: bool, name: str) -> DataFrame:
    """``value`` of the row ``n`` places away, across pieces. ``sp.frame`` gains ``name``."""
    near = (F.lead if forward else F.lag)(value, n).over(sp.window())
    if not sp.split:
        return sp.frame.withColumn(name, near)
    rn = F.row_number().over(sp.window(reverse=forward))
    out = sp.attach(sp.edges(value, n, forward)).withColumn("__near", near).withColumn("__rn", rn)
    outside = F.get("__edge", F.lit(n) - F.col("__rn"))
    return out.withColumn(
        name, F.when(F.col("__rn") > n, F.col("__near")).otherwise(outside)
    ).drop("__edge", "__near", "__rn")


def lag(
    df: DataFrame,
    col: str,
    n: int = 1,
    order_by=None,
    by: str | Iterable[str] | None = None,
    name: str | None = None,
    ties: bool = True,
) -> DataFrame:
    """Value of ``col`` ``n`` rows earlier, per group or over the whole table."""
    by = as_list(by)
    name = name or f"lag{n}_{col}"
    keys = total_order(df, by, order_by, ties)
    sp = Spread(df, by, keys)
    if sp.split and n > _NEAR:
        numbered = row_number(df, by, order_by, "__no", ties)
        source = numbered.select(
            *[F.col(b).alias(f"__b_{b}") for b in by],
            (F.col("__no") + n).alias("__to"),
            F.col(col).alias(name),
        )
        on = (F.col("__no") == F.col("__to")) & same_keys((F.col(b), F.col(f"__b_{b}")) for b in by)
        return sp.finish(numbered.join(source, on, "left"), name)
    return sp.finish(_offset(sp, col, n, False, name), name)


def by_flags(df: DataFrame, by, order_by, ties: bool = True) -> DataFrame:
    """``first_<k>`` / ``last_<k>`` for every BY key; an inner flag is set when any outer key changes.

    One shuffle on the outermost key and one sort serve all flags: each row only compares its keys
    with those of its neighbours.
    """
    by = as_list(by)
    outer, inner = parse(by)[0], parse(by)[1:]
    names = [outer.name] + [k.name for k in inner]
    rest = total_order(df, names, order_by, ties)
    sp = Spread(df, [outer.name], inner + rest)
    sp.add("__k", F.struct(F.lit(1).alias("row"), *names))
    sp.frame = _offset(sp, "__k", 1, False, "__prev")
    out = _offset(sp, "__k", 1, True, "__next")

    def differs(other: str, upto: int) -> Column:
        same = same_keys((F.col(k), F.col(other).getField(k)) for k in names[: upto + 1])
        return F.when(F.col(other).isNull() | ~same, 1).otherwise(0)

    flags = {}
    for i, k in enumerate(names):
        flags[f"first_{k}"] = differs("__prev", i)
        flags[f"last_{k}"] = differs("__next", i)
    return out.withColumns(flags).select(*df.columns, *flags)


def point(df: DataFrame, positions: Sequence[int], order_by, ties: bool = True) -> DataFrame:
    """Rows at the given 1-based positions, one output row per list entry, numbered in ``seq``."""
    wanted = df.sparkSession.createDataFrame(
        [(i, int(p)) for i, p in enumerate(positions, 1)], "seq bigint, position bigint"
    )
    indexed = row_index(df, order_by, "__no", ties)
    # the position list is an argument written by hand, so it is small by nature
    hits = indexed.join(F.broadcast(wanted), F.col("__no") == F.col("position"))
    return hits.select("seq", "position", *df.columns)


def split_n(df: DataFrame, n: int, order_by, name: str = "part_no", ties: bool = True) -> DataFrame:
    """Number the parts 1..n of a split by position with ceil(rows / n) rows each."""
    chunk = max(1, math.ceil(df.count() / n))
    indexed = row_index(df, order_by, "__no", ties)
    return indexed.withColumn(
        name, (F.floor((F.col("__no") - 1) / F.lit(chunk)) + 1).cast("bigint")
    ).drop("__no")


def head(df: DataFrame, n: int, order_by, ties: bool = True) -> DataFrame:
    """First ``n`` rows of the table (each task keeps n rows, then one merge)."""
    return df.orderBy(*sort_columns(total_order(df, [], order_by, ties))).limit(n)


def tail(df: DataFrame, n: int, order_by, ties: bool = True) -> DataFrame:
    """Last ``n`` rows of the table."""
    return df.orderBy(*sort_columns(total_order(df, [], order_by, ties), reverse=True)).limit(n)


def first_value(df: DataFrame, col: str, order_by, ties: bool = True) -> Column:
    """Value of ``col`` in the first row as a scalar that any other step can use."""
    return head(df, 1, order_by, ties).select(col).scalar()


def retain_fold(
    df: DataFrame,
    by,
    order_by,
    init,
    step: Callable[[Any, Any], Any],
    state_type: str = "double",
    name: str = "state",
    using: Sequence[str] | None = None,
    ties: bool = True,
) -> DataFrame:
    """General retained state: ``state = step(state, row)`` row by row within each group, from ``init`` on.

    ``step`` is a Python function; ``row`` has the columns ``using`` (all, if not given) as attributes, missing values as None.
    ``state_type`` is the type of the new column; the state itself may be any value of that type.

    One job, whatever the length of a group: rows are brought together by key and sorted, and each task folds its
    rows as one ordered stream of Arrow batches with the state carried along, so memory is bounded by a batch. Such a
    recurrence is sequential by nature: no engine can fold one group in parallel. Prefer ``running_sum``, ``row_number``
    or ``lag`` where the state is a sum, a counter or an earlier value. Without BY keys the table is one group.
    """
    by = as_list(by)
    using = list(df.columns if using is None else using)
    kept = df.drop(name)
    keys = total_order(kept, by, order_by, ties)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, df.sparkSession.range(0).select(F.lit(None).cast(state_type).alias("s")).schema["s"].dataType)])
    ordered = (kept.repartition(*by) if by else kept.repartition(1)).sortWithinPartitions(*sort_columns([*map(Key, by), *keys]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = namedtuple("Row", using, rename=True)
        group, state, kind = None, init, to_arrow_type(schema[name].dataType)
        for batch in batches:
            owners = zip(*[batch.column(b).to_pylist() for b in by]) if by else repeat((), batch.num_rows)
            values = zip(*[batch.column(u).to_pylist() for u in using])
            states = []
            for owner, value in zip(owners, map(row._make, values)):
                if group is None or owner != group and not all(a == b or a != a and b != b for a, b in zip(owner, group)):
                    group, state = owner, init  # NaN keys are one group
                state = step(state, value)
                states.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, kind)], schema.names)

    return ordered.mapInArrow(fold, schema)
