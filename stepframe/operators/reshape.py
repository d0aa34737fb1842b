"""Transposition and row generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import as_list
from .spread import fan_out


def to_long(df: DataFrame, by, vars, name: str = "variable", value: str = "value") -> DataFrame:
    """One row per key and variable. Mixed numeric types become double, others text."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = {types[v] for v in vars}
    cast = None
    if len(kinds) > 1:
        numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
        cast = "double" if kinds <= numeric else "string"
    cols = [F.col(v).cast(cast).alias(v) if cast else F.col(v) for v in vars]
    return df.select(*as_list(by), *cols).unpivot(as_list(by), list(vars), name, value)


def to_wide(df: DataFrame, by, id: str, var: str, values: Sequence | None = None) -> DataFrame:
    """One row per key, one column per value of ``id``. Two rows for one cell are an error."""
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"two rows for one cell of {id}"))).otherwise(
        F.first(var)
    )
    return df.groupBy(*as_list(by)).pivot(id, list(values) if values else None).agg(cell)


def expand_months(df: DataFrame, start: str, end: str, date: str = "month_start", month: str = "month_name") -> DataFrame:
    """One row per calendar month touched by start..end; none when the end lies before the start."""
    first, last = F.trunc(F.col(start), "MM"), F.trunc(F.col(end), "MM")
    ok = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (first <= last))
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return ok.withColumn(date, F.explode(months)).withColumn(month, F.upper(F.date_format(date, "MMMM")))


def rows(spark: SparkSession, first: int, last: int, name: str = "i") -> DataFrame:
    """``do i = first to last; output;``"""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def expand_range(df: DataFrame, first: Column, last: Column, name: str = "i") -> DataFrame:
    """Counted loop per input row; no rows when first > last."""
    ok = df.where(first <= last)
    return ok.withColumn(name, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))


#: rounds after which a loop counts as endless
ENDLESS = 10_000_000
#: rows of a loop that leave a task together
_OUT_ROWS = 8_192


def generate(
    df: DataFrame,
    state: Mapping[str, Column],
    cond: Callable[[Mapping[str, pd.Series]], pd.Series],
    step: Callable[[Mapping[str, pd.Series]], Mapping[str, pd.Series]],
    until: bool = False,
    output: str = "after",
    max_steps: int = ENDLESS,
) -> DataFrame:
    """Rows from a loop over each input row's own state.

    ``state`` gives the start values as columns. ``cond(s)`` and ``step(s)`` get the states of all rows of a batch whose
    loop goes on, as Arrow-backed series by name (missing values stay missing), and answer for all of them at once:
    true or false, and the next values of the states that change. ``cond`` is tested before each round (DO WHILE) or, with
    ``until=True``, after it and ends the loop (DO UNTIL, at least one row); missing counts as false.
    ``output="after"`` emits the state after the step, ``"before"`` the one before it. The output has the input
    columns, the state columns and ``step_no``.

    One lazy stage, whatever the number of rounds: a task keeps one state per row of a batch and sends rows on as
    they are made. A loop that has not ended after ``max_steps`` rounds is taken for endless and fails.
    """
    fields = list(state)
    own = [c for c in df.columns if c not in fields]
    start = df.select(*own, *[state[f].alias(f) for f in fields])
    types = {f.name: T.StructField(f.name, f.dataType) for f in start.schema.fields}
    schema = T.StructType([types[c] for c in [*own, *fields]] + [T.StructField("step_no", T.LongType())])

    def loop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = {f: batch.schema.field(f).type for f in fields}
            held, size, rounds = [], 0, 0
            at = np.arange(batch.num_rows)
            s = {f: pd.Series(batch.column(f), dtype=pd.ArrowDtype(kinds[f])) for f in fields}

            def going(s, at):
                met = pd.Series(cond(s)).to_numpy(dtype=bool, na_value=False)
                live = ~met if until else met
                return (s, at) if live.all() else ({f: v[live].reset_index(drop=True) for f, v in s.items()}, at[live])

            def out():
                rows = np.concatenate([h[0] for h in held])
                values = [pa.concat_arrays([h[1][f] for h in held]) for f in fields]
                steps = np.repeat([h[2] for h in held], [len(h[0]) for h in held])
                taken = batch.take(pa.array(rows))
                return pa.RecordBatch.from_arrays([*[taken.column(c) for c in own], *values, pa.array(steps, pa.int64())], schema.names)

            if not until:
                s, at = going(s, at)
            while len(at):
                if rounds >= max_steps:
                    raise RuntimeError(f"loop not finished after {max_steps} steps")
                rounds += 1
                new = step(s)
                after = {f: _typed(new[f], kinds[f], len(at)) if f in new else v for f, v in s.items()}
                held.append((at, {f: _arrow(v, kinds[f]) for f, v in (after if output == "after" else s).items()}, rounds))
                size += len(at)
                if size >= _OUT_ROWS:
                    yield out()
                    held, size = [], 0
                s, at = going(after, at)
            if held:
                yield out()

    return fan_out(start).mapInArrow(loop, schema)


def _arrow(values: pd.Series, kind: pa.DataType) -> pa.Array:
    found = pa.array(values, kind)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _typed(values, kind: pa.DataType, n: int) -> pd.Series:
    """The next values of a state, in the type it has had from the start."""
    if not isinstance(values, pd.Series):
        values = pd.Series([values] * n)
    if values.dtype == pd.ArrowDtype(kind):
        return values
    found = pa.array(values, from_pandas=True)
    return pd.Series(found.cast(kind, safe=False) if found.type != kind else found, dtype=pd.ArrowDtype(kind))

