"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: bytes of text that a task turns into arrays at once; longer texts come alone
SLICE_BYTES = 1 << 20
#: bytes of rows that are handed to Python at once while an intermediate table is made
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where ``use`` names it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in batches of ``BATCH_BYTES`` meanwhile.

    Spark's bound is 10,000 rows or 64 MB of texts, several times over in each executor.
    """
    own = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, own)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches holding about ``limit`` bytes of text, with the texts as UTF-8 (null: empty).

    Only the texts of one part are made into Python objects at a time.
    """
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        first = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if size and size + n > limit:
                yield batch.slice(first, i - first), [x or b"" for x in texts.slice(first, i - first).to_pylist()]
                first, size = i, 0
            size += n
        if first < len(texts):
            yield batch.slice(first), [x or b"" for x in texts.slice(first).to_pylist()]
        del batch, texts  # before the next one is read


_KEPT: dict = {"owner": None, "things": {}}


def kept_by(owner: str) -> dict:
    """What this Python worker keeps from one task to the next, for one operator at a time.

    Workers outlive a stage. When another operator's tasks come, what the last one kept goes first, and the memory is
    given back to the system, so that the stages of a pipeline do not add up in one worker.
    """
    if _KEPT["owner"] != owner:
        _KEPT.update(owner=owner, things={})
        gc.collect()
        give_back()
    return _KEPT["things"]


def give_back() -> None:
    """Gives memory that is free in this Python worker back to the system: an idle worker would go on holding it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for ``mapInArrow``, after whose last batch a task gives back the memory that it no longer needs."""

    def task(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return task


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns called like one of ``names`` renamed out of the way, and what each is called now."""
    taken, to = {c.lower() for c in docs.columns} | set(names), {}
    for c in docs.columns:
        if c.lower() in names:
            new = f"{c}_own"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            to[c] = new
    return docs.withColumnsRenamed(to), to


def back(df: DataFrame, columns: list[str], to: dict[str, str]) -> DataFrame:
    """``columns`` of ``df`` under the names they had before ``aside``."""
    return df.select(*[F.col(to.get(c, c)).alias(c) for c in columns])
