"""Exact k nearest vectors through a metric index.

Vectors are assigned to the nearest of some pivots; the cells of the pivots are put together to blocks of a bounded number
of rows, neighbours first, and a cell that is larger than a block is dealt over several. What lies in cells and blocks is
a table in the shared folder. A query knows an upper bound of its k-th distance from a bounded sample of the vectors, and by the
triangle inequality it only travels to blocks with a cell that can hold something nearer. There the same inequality rules
out cells and the rims of cells again, with bounds that shrink as hits are found; what is left is measured.

Nothing depends on the sample but the amount of work. Where distances hardly differ (random vectors of many dimensions) no
metric index can rule out much; ``pairs_measured`` tells the share that was measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: vectors in one block, and queries that meet it at a time; more than so many blocks make them larger
BLOCK_ROWS = 16_384
CHUNK_ROWS = 16_384
MAX_BLOCKS = 65_536
#: numbers in the pivots and in the sample that bounds the k-th distance; both are shipped to all tasks
SAMPLE_CELLS = 1 << 19
MAX_PIVOTS = 1_024
MAX_PROBES = 4_096
#: queries that are compared with a cell at a time
_GROUP = 512


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return ((v - q) ** 2).sum(-1)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_pandas()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _ids(column) -> np.ndarray:
    found = np.asarray(column.to_pandas())
    return found.astype(str) if found.dtype == object else found


def _rough(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a matrix product, and a bound of their rounding errors."""
    q2, v2 = (q**2).sum(1), (v**2).sum(1)
    return q2[:, None] + v2[None, :] - 2.0 * q @ v.T, 1e-9 * (q2.max(initial=0.0) + v2.max(initial=0.0) + 1.0)


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_rough(q, v)[0], 0.0))


class Pivots(NamedTuple):
    points: np.ndarray  # in an order that has neighbours side by side
    probes: np.ndarray  # different vectors of the table
    slack: float  # what rounding may add to a distance


class Cells(NamedTuple):
    near: np.ndarray  # least and largest distance from the pivot
    far: np.ndarray
    first: np.ndarray  # first block of the cell, and how many blocks it is dealt over
    parts: np.ndarray
    blocks: int


def _chain(points: np.ndarray) -> np.ndarray:
    """The points in an order that goes on to the nearest one left."""
    left, order = np.ones(len(points), bool), [0]
    for _ in range(len(points) - 1):
        left[order[-1]] = False
        d = _exact(points[order[-1]], points)
        order.append(int(np.where(left, d, np.inf).argmin()))
    return points[order]


def choose_pivots(vectors: DataFrame, rows: int) -> Pivots | None:
    """Vectors with the least hashes of their ids: a sample of bounded size that a retry finds again."""
    head = vectors.select(F.size("v").alias("n")).head()
    if head is None:
        return None
    most = max(2, SAMPLE_CELLS // max(1, head.n))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(min(MAX_PROBES, most)).select("v").toArrow()
    found = _matrix(sample["v"])
    probes = found[np.sort(np.unique(found, axis=0, return_index=True)[1])]
    wanted = max(1, min(MAX_PIVOTS, len(probes), math.ceil(math.sqrt(rows))))
    return Pivots(_chain(probes[:wanted]), probes, 1e-7 * (1.0 + float(np.sqrt((probes**2).sum(1).max(initial=0.0)))))


def assign(vectors: DataFrame, pivots: Broadcast, k: int) -> DataFrame:
    """(cell, r, id, v): nearest pivot and distance from it; of equal vectors in a batch only the ``k`` least ids stay."""
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType()), vectors.schema["id"], vectors.schema["v"]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.value.points
        for batch in batches:
            if not batch.num_rows:
                continue
            mat = np.ascontiguousarray(_matrix(batch.column("v")))
            same = np.unique(mat.view([("", f"V{mat.shape[1] * 8}")]).ravel(), return_inverse=True)[1].ravel()
            if same.max() + 1 < len(same):
                order = np.lexsort((_ids(batch.column("id")), same))
                begins = np.flatnonzero(np.diff(same[order], prepend=-1))
                copy = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
                kept = np.sort(order[copy < k])
                batch, mat = batch.take(pa.array(kept)), mat[kept]
            cell = _rough(mat, points)[0].argmin(1)
            r = np.sqrt(_exact(mat, points[cell]))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(r), batch.column("id"), batch.column("v")], schema.names)

    return vectors.mapInArrow(work, schema)


def lay_out(cells: list, pivots: int, rows: int) -> Cells:
    """Blocks of neighbouring cells with at most ``BLOCK_ROWS`` rows; larger cells are dealt over blocks of their own."""
    size = max(BLOCK_ROWS, math.ceil(rows / MAX_BLOCKS))
    near, far = np.full(pivots, np.inf), np.full(pivots, -np.inf)
    first, parts = np.zeros(pivots, np.int64), np.ones(pivots, np.int64)
    block = held = 0
    for r in sorted(cells, key=lambda r: r.cell):
        near[r.cell], far[r.cell] = r.near, r.far
        if held and held + r.rows > size:
            block, held = block + 1, 0
        first[r.cell], parts[r.cell] = block, max(1, math.ceil(r.rows / size))
        held += r.rows
        if parts[r.cell] > 1:
            block, held = block + int(parts[r.cell]), 0
    return Cells(near, far, first, parts, block + (held > 0))


def _wanted(q: np.ndarray, pivots: Pivots, cells: Cells, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper bound of each query's k-th distance, and which cells may hold something within it."""
    if len(pivots.probes) >= k:
        reach = np.sqrt(np.maximum(np.partition(_rough(q, pivots.probes)[0], k - 1, axis=1)[:, k - 1], 0.0)) + pivots.slack
    else:
        reach = np.full(len(q), np.inf)
    d = _distances(q, pivots.points)
    return reach, np.maximum(d - cells.far, cells.near - d) <= reach[:, None] + pivots.slack


def route(queries: DataFrame, pivots: Broadcast, cells: Broadcast, k: int, count: bool = False) -> DataFrame:
    """(block, reach, id, v): a row for each block that a query has to see; with ``count`` only (block, n) of each batch."""
    fields = [T.StructField("n", T.LongType())] if count else [T.StructField("reach", T.DoubleType()), queries.schema["id"], queries.schema["v"]]
    schema = T.StructType([T.StructField("block", T.LongType()), *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Cells = cells.value
        cell = np.repeat(np.arange(len(c.first)), c.parts)  # of each block that a cell has a part in
        block = np.concatenate([np.arange(f, f + p) for f, p in zip(c.first, c.parts)])
        step = max(1, (1 << 20) // max(c.blocks, len(c.first)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                reach, need = _wanted(_matrix(batch.column("v")), pivots.value, c, k)
                see = np.zeros((len(reach), c.blocks), bool)
                rows, places = np.nonzero(need[:, cell])
                see[rows, block[places]] = True
                if count:
                    n = see.sum(0)
                    used = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], schema.names)
                    continue
                rows, to = np.nonzero(see)
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(reach[rows]), taken.column("id"), taken.column("v")], schema.names)

    return queries.mapInArrow(work, schema)


class _Best:
    """The k best (distance, id) of some queries; equal distances go to the smaller id."""

    def __init__(self, n: int, k: int, kind: np.dtype):
        self.k = k
        self.d, self.id = np.full((n, k), np.inf), np.zeros((n, k), kind)

    def add(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(rows)
        old = np.repeat(touched, self.k)
        row = np.concatenate([old, rows])
        d, ids = np.concatenate([self.d[touched].ravel(), d]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, d, row))
        begins = np.searchsorted(row[order], touched)
        place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        kept = order[place < self.k]
        self.d[row[kept], place[place < self.k]], self.id[row[kept], place[place < self.k]] = d[kept], ids[kept]


def _search(q, reach, cell, r, v, ids, pivots: Pivots, k: int) -> tuple[_Best, int]:
    """The best of one block for the queries, and how many pairs were measured."""
    order = np.lexsort((r, cell))
    cell, r, v, ids = cell[order], r[order], v[order], ids[order]
    own, begins = np.unique(cell, return_index=True)
    ends = np.append(begins[1:], len(cell))
    d = _distances(q, pivots.points[own])
    best, measured = _Best(len(q), k, ids.dtype), 0
    queue = np.lexsort((d.min(1), d.argmin(1)))
    for at in range(0, len(q), _GROUP):
        group = queue[at : at + _GROUP]
        low = np.maximum(d[group] - r[ends - 1], r[begins] - d[group])
        for c in np.argsort(low.min(0), kind="stable"):
            limit = np.minimum(reach[group], np.sqrt(best.d[group, -1])) + pivots.slack
            live = low[:, c] <= limit
            if not live.any():
                continue
            rows, limit = group[live], limit[live]
            inner = r[begins[c] : ends[c]]
            a = begins[c] + np.searchsorted(inner, (d[rows, c] - limit).min() - pivots.slack)
            b = begins[c] + np.searchsorted(inner, (d[rows, c] + limit).max() + pivots.slack, side="right")
            if a >= b:
                continue
            measured += len(rows) * int(b - a)
            rough, margin = _rough(q[rows], v[a:b])
            if b - a > k and not np.isfinite(limit).all():
                limit = np.minimum(limit, np.sqrt(np.maximum(np.partition(rough, k - 1, axis=1)[:, k - 1], 0.0) + margin) + pivots.slack)
            x, y = np.nonzero(rough <= (limit**2 + margin)[:, None])
            if len(x):
                best.add(rows[x], _exact(q[rows[x]], v[a + y]), ids[a + y])
    return best, measured


def tiles(queries: DataFrame, vectors: DataFrame, k: int, count: bool = False) -> DataFrame | None:
    """(query_id, vector_id, distance) with the k best of every block, or (measured) pairs of every block; None without vectors.

    Both inputs have the columns ``id`` and ``v``. Block and chunk of queries make one group of bounded size.
    """
    spark = queries.sparkSession
    rows = vectors.count()
    chosen = choose_pivots(vectors, rows)
    if chosen is None:
        return None
    pivots = spark.sparkContext.broadcast(chosen)
    path = scratch_path(spark, "metric-index")
    assign(vectors, pivots, k).write.parquet(path)
    index = spark.read.parquet(path)
    found = index.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("near"), F.max("r").alias("far")).collect()
    layout = lay_out(found, len(chosen.points), sum(r.rows for r in found))
    cells = spark.sparkContext.broadcast(layout)
    meets = route(queries, pivots, cells, k, count=True).groupBy("block").agg(F.sum("n").alias("n"))
    chunks = spark.createDataFrame([(r.block, math.ceil(r.n / CHUNK_ROWS)) for r in meets.collect()], "block long, chunks int")  # at most MAX_BLOCKS and MAX_PIVOTS rows
    places = spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(layout.first, layout.parts))], "cell int, first long, parts int")
    placed = index.join(F.broadcast(places), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts")))
    left = placed.join(F.broadcast(chunks), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("block", "chunk", "cell", "r", "id", "v")
    right = route(queries, pivots, cells, k).join(F.broadcast(chunks), "block").select("block", F.pmod(F.xxhash64("id", "v"), F.col("chunks")).cast("int").alias("chunk"), "reach", "id", "v")
    hits = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("vector_id", vectors.schema["id"].dataType), T.StructField("distance", T.DoubleType())])

    def search(v: pa.Table, q: pa.Table) -> pa.Table:
        if not v.num_rows or not q.num_rows:
            best, measured = None, 0
        else:
            best, measured = _search(_matrix(q["v"]), np.asarray(q["reach"]), np.asarray(v["cell"]), np.asarray(v["r"]), _matrix(v["v"]), _ids(v["id"]), pivots.value, k)
        if count:
            return pa.table({"measured": pa.array([measured], pa.int64())})
        kind = pa.string() if isinstance(hits["vector_id"].dataType, T.StringType) else v.schema.field("id").type
        if best is None:
            return pa.table([pa.array([], q.schema.field("id").type), pa.array([], kind), pa.array([], pa.float64())], names=hits.names)
        x, y = np.nonzero(np.isfinite(best.d))
        return pa.table([q["id"].take(pa.array(x)), pa.array(best.id[x, y]).cast(kind), pa.array(best.d[x, y])], names=hits.names)

    groups = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    return groups.applyInArrow(search, "measured long" if count else hits)
