"""Datasets by name: catalog tables, views and parquet folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, name: str, base: str | None = None) -> DataFrame:
    """``table``, ``schema.table`` or, with ``base``, the parquet file ``<base>/<name>.parquet``."""
    if base is not None:
        return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return spark.table(name)


def save(df: DataFrame, name: str, table: bool = False, fmt: str = "parquet") -> DataFrame:
    """Create or replace a dataset: a session view, or a stored table with ``table=True``."""
    if table:
        df.write.mode("overwrite").format(fmt).saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def split_by_value(df: DataFrame, col: str, values: Sequence, prefix: str = "") -> dict[str, DataFrame]:
    """One filtered dataset per listed value; the filter reaches the scan."""
    return {f"{prefix}{v}": df.where(F.col(col) == v) for v in values}


def write_by_value(df: DataFrame, col: str, path: str, fmt: str = "parquet") -> None:
    """One folder per value of ``col``, written in a single pass.

    Rows are rebalanced by value first: adaptive execution cuts a value with very many rows into
    several tasks and puts small values together, so files get a sensible size either way.
    """
    df.hint("rebalance", col).write.mode("overwrite").format(fmt).partitionBy(col).save(path)
