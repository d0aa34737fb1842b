"""Column-wise steps: conditional assignment, renaming, column lists, metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def subset_if(df: DataFrame, cond: Column) -> DataFrame:
    """Keep rows for which ``cond`` is true; written after the derivations it refers to."""
    return df.where(cond)


def delete_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Drop rows for which ``cond`` is true. A missing condition does not delete."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def assign_when(
    df: DataFrame,
    branches: Sequence[tuple[Column, Mapping[str, Column]]],
    else_: Mapping[str, Column] | None = None,
) -> DataFrame:
    """IF / ELSE IF / ELSE groups that assign several columns per branch, in one projection.

    The first true branch wins. A column not assigned in the chosen branch keeps its old value, or
    is missing when it is new.
    """
    else_ = else_ or {}
    targets = list(dict.fromkeys([c for _, b in branches for c in b] + list(else_)))
    chain = F.lit(None).cast("int") if not branches else None
    for i, (cond, _) in enumerate(branches):
        chain = F.when(cond, i) if chain is None else chain.when(cond, i)
    chosen = F.coalesce(chain, F.lit(len(branches)))
    out = {}
    for t in targets:
        old = F.col(t) if t in df.columns else F.lit(None)
        expr = None
        for i, values in enumerate([b for _, b in branches] + [else_]):
            if t in values:
                expr = F.when(chosen == i, values[t]) if expr is None else expr.when(chosen == i, values[t])
        out[t] = expr.otherwise(old)
    return df.withColumns(out)


def select_when(value: Column, branches: Mapping[object, Column], otherwise: Column | None = None) -> Column:
    """SELECT / WHEN / OTHERWISE on one value."""
    expr = None
    for match, result in branches.items():
        expr = F.when(value == match, result) if expr is None else expr.when(value == match, result)
    return expr if otherwise is None else expr.otherwise(otherwise)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """RENAME= with all names changed at once, so ``{a: b, b: a}`` swaps."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"cannot rename unknown columns {missing}")
    return df.select([F.col(c).alias(names.get(c, c)) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numbered(df: DataFrame, prefix: str, first: int, last: int) -> list[str]:
    """``prefix<first>`` .. ``prefix<last>``, those that exist."""
    have = set(df.columns)
    return [c for c in (f"{prefix}{i}" for i in range(first, last + 1)) if c in have]


def map_columns(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """The same expression over a list of columns, in one projection."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def fill(df: DataFrame, cols: Iterable[str], value) -> DataFrame:
    """Replace missing values; the column type does not change."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(types[c])) for c in cols})


def label(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    return _metadata(df, "label", labels)


def set_format(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    return _metadata(df, "format", formats)


def _metadata(df: DataFrame, key: str, values: Mapping[str, str]) -> DataFrame:
    old = {f.name: f.metadata or {} for f in df.schema.fields}
    for c, v in values.items():
        df = df.withMetadata(c, {**old[c], key: v})
    return df


def copies(df: DataFrame, name: str, n: int) -> dict[str, DataFrame]:
    """``n`` names for the same lazy plan."""
    return {f"{name}{i}": df for i in range(1, n + 1)}
