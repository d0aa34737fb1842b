"""Keyed dataset merge with presence flags, and the other joins that need care with missing keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import as_list, same_keys
from .spread import has_hot_group

_L, _R = "__in_left", "__in_right"
_HOW = {"all": "full", "both": "inner", "left": "left", "right": "right"}
KEEP = (*_HOW, "left_only", "right_only")
#: types that Spark widens to each other without loss of meaning; nested ones are left to Spark
_FAMILIES = (T.NumericType, (T.StringType, T.CharType, T.VarcharType), (T.DateType, T.TimestampType, T.TimestampNTZType), (T.ArrayType, T.MapType, T.StructType))


def merge(
    frames: Sequence[DataFrame],
    by,
    keep: str | Column = "all",
    flags: Sequence[str] | None = None,
    split_hot: bool | None = None,
) -> DataFrame:
    """Match-merge of two or more datasets on ``by``.

    * Missing keys match missing keys.
    * A non-key column that several datasets have takes the value of the last dataset *that has a
      row for the key*, even when that value is missing.
    * ``keep``: ``all``, ``both``, ``left``, ``right``, ``left_only``, ``right_only`` for two
      datasets; for any number of datasets also a condition over the ``flags`` columns.
    * ``flags`` names one 0/1 column per dataset telling whether it contributed to the row.
    * ``left_only`` keeps the columns of the right dataset, all missing.

    Adaptive execution splits a skewed inner join on both sides but cannot split a full join, nor
    the optional side of an outer one. When a key is hot there, or ``split_hot=True``, the merge
    runs as inner join plus anti-joins against the distinct keys, each of which can be split.
    ``split_hot=None`` finds out from row counts and a sample of the keys of the sides concerned;
    pass ``False`` for inputs with one row per key.
    """
    by = as_list(by)
    if len(frames) < 2:
        raise ValueError("merge needs at least two datasets")
    if isinstance(keep, str) and keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP} or a condition over flags")
    if isinstance(keep, str) and keep != "all" and len(frames) > 2:
        raise ValueError("name the inputs with flags and pass a condition to merge three or more")
    names = list(flags) if flags else [f"__in{i}" for i in range(len(frames))]
    if len(names) != len(frames):
        raise ValueError("one flag name per dataset")
    _check_types(frames)
    how = keep if isinstance(keep, str) else "all"
    if how in ("left_only", "right_only") and not flags:
        return _only(*(frames if how == "left_only" else frames[::-1]), by, frames)
    if split_hot is None:
        optional = {"all": frames, "left": frames[1:], "right": frames[:1]}.get(how, [])
        split_hot = any(has_hot_group(f, by) for f in optional)

    marked = [f.withColumn(n, F.lit(1)) for f, n in zip(frames, names)]
    out = marked[0]
    for i, right in enumerate(marked[1:], 1):
        out = _pair(out, right, by, how if how in _HOW else "all", names[:i], names[i], split_hot)
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})
    if how == "left_only":
        out = out.where((F.col(names[0]) == 1) & (F.col(names[1]) == 0))
    elif how == "right_only":
        out = out.where((F.col(names[0]) == 0) & (F.col(names[1]) == 1))
    elif not isinstance(keep, str):
        out = out.where(keep)
    data = [c for c in out.columns if c not in names]
    return out.select(*data, *names) if flags else out.select(*data)


def _check_types(frames: Sequence[DataFrame]) -> None:
    """A column that several datasets have must be of one family of types: numbers, texts, days and times, or one type."""
    seen: dict[str, T.DataType] = {}
    for f in (f for df in frames for f in df.schema.fields if not isinstance(f.dataType, T.NullType)):
        first = seen.setdefault(f.name, f.dataType)
        if first != f.dataType and not any(isinstance(first, kind) and isinstance(f.dataType, kind) for kind in _FAMILIES):
            raise ValueError(f"column {f.name} is {first.simpleString()} in one dataset and {f.dataType.simpleString()} in another; cast it before the merge")


def _pair(left, right, by, how, left_flags, right_flag, split_hot) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in right.columns if c != right_flag})
    on = same_keys((left[b], renamed[f"__r_{b}"]) for b in by)
    if not split_hot or how == "both":
        joined = left.join(renamed, on, _HOW[how])
    else:
        joined = left.join(renamed, on, "inner")
        if how in ("all", "left"):
            joined = joined.unionByName(_anti(left, right, by), allowMissingColumns=True)
        if how in ("all", "right"):
            alone = _anti(right, left, by).withColumnsRenamed(
                {c: f"__r_{c}" for c in right.columns if c != right_flag}
            )
            joined = joined.unionByName(alone, allowMissingColumns=True)
    in_right = F.col(right_flag).isNotNull()
    in_left = F.coalesce(*left_flags).isNotNull()
    cols = []
    for c in left.columns:
        if c in by:
            cols.append(F.when(in_left, F.col(c)).otherwise(F.col(f"__r_{c}")).alias(c))
        elif c in right.columns:
            cols.append(F.when(in_right, F.col(f"__r_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    new = [c for c in right.columns if c not in left.columns and c != right_flag]
    return joined.select(*cols, *[F.col(f"__r_{c}").alias(c) for c in new], right_flag)


def _anti(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = other.select(*[F.col(b).alias(f"__a_{b}") for b in by]).distinct()
    return df.join(keys, same_keys((df[b], keys[f"__a_{b}"]) for b in by), "left_anti")


def _only(side: DataFrame, other: DataFrame, by, frames) -> DataFrame:
    """Rows of one side without a partner; columns of the other side stay, all missing."""
    alone = _anti(side, other, by)
    types = {f.name: f.dataType for df in (other, side) for f in df.schema.fields}
    order = list(dict.fromkeys(frames[0].columns + frames[1].columns))
    return alone.select(
        [F.col(c) if c in side.columns else F.lit(None).cast(types[c]).alias(c) for c in order]
    )


def not_in(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows whose key does not occur in ``other``; a missing key matches a missing key.

    SQL ``NOT IN`` would return nothing once the list holds a NULL, and a plain ``left_anti`` would
    keep rows with a missing key. The list is reduced to distinct keys before the join.
    """
    return _anti(df, other, as_list(on))


def with_scalar(df: DataFrame, name: str, source: DataFrame, agg: Column) -> DataFrame:
    """Add a one-value summary of ``source`` to every row (a scalar subquery, not a join)."""
    return df.withColumn(name, source.agg(agg).scalar())


def lookup_self(df: DataFrame, key: str, ref: str, take: Mapping[str, str]) -> DataFrame:
    """Left self-join: follow ``ref`` to the row with that ``key`` and take renamed columns."""
    right = df.select(F.col(key).alias("__key"), *[F.col(c).alias(n) for c, n in take.items()])
    return df.join(right, F.col(ref) == F.col("__key"), "left").drop("__key")


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all datasets; columns are united by name, absent ones are missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
