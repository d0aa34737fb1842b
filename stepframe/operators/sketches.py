"""Distinct counts that add up: sketches per class, kept as a table and united later.

An exact distinct count cannot be made from the counts of parts. A sketch of a part can be stored, and sketches of any
parts unite to the sketch of their union. A sketch has at most ``2 ** precision`` cells whatever the number of
values; its standard error is ``distinct_error(precision)``, about 0.8 % for 14.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import as_list

#: types that a sketch takes as they are; others are taken by their text
_PLAIN = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def distinct_error(precision: int = 14) -> float:
    """Standard error of a distinct count, relative to the count."""
    return 1.04 / math.sqrt(2**precision)


def distinct_sketches(df: DataFrame, vars, by=None, precision: int = 14, include_missing: bool = False) -> DataFrame:
    """One row per class with a sketch ``<var>_sketch`` of each variable's non-missing values.

    Tasks combine their own rows first, so a class that holds most rows moves one sketch per task. Rows with a missing
    class are left out unless ``include_missing``.
    """
    vars, by = as_list(vars), as_list(by)
    if not include_missing:
        for b in by:
            df = df.where(F.col(b).isNotNull())
    value = lambda v: F.col(v) if isinstance(df.schema[v].dataType, _PLAIN) else F.col(v).cast("string")
    return (df.groupBy(*by) if by else df).agg(*[F.hll_sketch_agg(value(v), precision).alias(f"{v}_sketch") for v in vars])


def unite_sketches(sketches: DataFrame, by=None) -> DataFrame:
    """Sketches of coarser classes: those of ``by``, some of the classes that the table has, or of everything.

    Sketches of different precision unite to the lower one.
    """
    by = as_list(by)
    names = [f.name for f in sketches.schema.fields if f.name.endswith("_sketch")]
    united = [F.hll_union_agg(n, True).alias(n) for n in names]
    return (sketches.groupBy(*by) if by else sketches).agg(*united)


def sketch_counts(sketches: DataFrame) -> DataFrame:
    """The table with each ``<var>_sketch`` replaced by the estimate ``<var>_distinct``."""
    out = []
    for f in sketches.schema.fields:
        stem = f.name.removesuffix("_sketch")
        out.append(F.coalesce(F.hll_sketch_estimate(f.name), F.lit(0)).alias(f"{stem}_distinct") if stem != f.name else F.col(f.name))
    return sketches.select(*out)
