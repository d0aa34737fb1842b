"""Ranked lexical search: range-maximum tables over posting lists, best intervals of documents first.

A document's score for an item is the sum over the item's terms, repeats included, of an integer impact. The documents of a
block stand in ascending order of their ids, and each term's posting list holds places and impacts with a sparse table that gives
the largest impact of any range of the list in two look-ups. The sum of these maxima bounds every score in an interval of
documents. Each item's intervals with the highest bounds are taken first; an interval is split at the document where the term
with the largest share has its largest impact, that document is scored exactly, and the two rests get bounds of their own.
Intervals whose bound cannot beat the item's k-th best document so far are dropped; a bound equal to that score only counts
if the interval holds a smaller id, so ties are settled exactly and thousands of copies cost no more than k of them.

One pass writes, for each document, its number of terms and how often it holds the terms of the items (nothing is shuffled);
term frequencies are aggregates over that table; a second pass searches it block by block and emits at most k rows for each item
and task, of which a pruned window keeps k. Items travel in blocks of ``ITEM_BYTES`` bytes, one search for each; the terms of a
block are all that is broadcast.

Null and empty texts have no terms: such documents are not counted, such items have no rows. Equal item rows are ranked once,
item rows with one id and different texts are ranked each by itself. A document row is a document, also if ids repeat; a
null id counts as smallest.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, written

#: hits for each item
TOP_K = 20
#: bytes of item texts that one search takes
ITEM_BYTES = 2 << 20
#: postings of one block of documents; its range-maximum tables take about 100 bytes for each
BLOCK_POSTINGS = 400_000
#: intervals of one item that are split at a time
AT_ONCE = 8
#: (interval, term) cells that are worked on at a time
CELLS = 1 << 19

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Stretches of ASCII letters and digits and of bytes above 127, ASCII letters in lower case."""
    return text.translate(_TABLE).split()


def term_counts(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf): terms of each document with repeats, and numbers and counts of those in ``vocabulary``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    shipped = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value
        for part, texts in byte_slices(batches):
            n, terms, tf = [], [], []
            for x in texts:
                words = terms_of(x)
                found = Counter(filter(number.__contains__, words))
                n.append(len(words))
                terms.append([number[t] for t in found])
                tf.append(list(found.values()))
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(work, schema).where("n > 0")


def impact(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Share of one occurrence of a term in an item, for a term that stands ``tf`` times in a document of ``n`` terms."""
    m = 75 + 25 * n * documents // length
    return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


class Block:
    """Posting lists of some documents, numbered in the order of their ids, with range-maximum tables."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, documents: int):
        order = np.lexsort((doc, term))
        self.documents, self.value = documents, value[order]
        self.key = term[order].astype(np.int64) * documents + doc[order]
        self.doc = doc[order]
        longest = int(np.bincount(term).max()) if len(term) else 1
        best = np.arange(len(order), dtype=np.int32)
        self.best = [best]
        # level j: the first largest of 2 ** j postings; ranges never leave a list, so one table serves all lists
        for j in range(longest.bit_length() - 1):
            left, right = self.best[-1][: -(1 << j)], self.best[-1][1 << j :]
            self.best.append(np.where(self.value[right] > self.value[left], right, left))
        width = len(order)
        self.table = np.zeros((len(self.best), max(1, width)), np.int32)
        for j, row in enumerate(self.best):
            self.table[j, : len(row)] = row

    def places(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """First posting of the term at or after the document."""
        return np.searchsorted(self.key, term.astype(np.int64) * self.documents + doc)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Posting with the first largest value of each range; -1 for an empty one."""
        width = hi - lo
        level = np.frexp(np.maximum(width, 1).astype(np.float64))[1] - 1
        a = self.table[level, np.where(width > 0, lo, 0)]
        b = self.table[level, np.where(width > 0, hi - (1 << level), 0)]
        return np.where(width > 0, np.where(self.value[b] > self.value[a], b, a), -1)


class Best:
    """The k best (score, document) of every item: high scores first, equal ones by ascending document."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.rank = np.full((items, k), np.iinfo(np.int64).max, np.int64)  # order of the document's id, for ties
        self.row = np.full((items, k), -1, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, rank: np.ndarray, row: np.ndarray) -> None:
        """Hits of documents not seen before; ``item`` is sorted."""
        if not len(item):
            return
        touched, begins = np.unique(item, return_index=True)
        many = np.diff(np.append(begins, len(item)))
        width = self.k + int(many.max())
        s, r, w = np.zeros((len(touched), width), np.int64), np.full((len(touched), width), np.iinfo(np.int64).max), np.full((len(touched), width), -1, np.int64)
        s[:, : self.k], r[:, : self.k], w[:, : self.k] = self.score[touched], self.rank[touched], self.row[touched]
        y = np.repeat(np.arange(len(touched)), many)
        x = self.k + np.arange(len(item)) - np.repeat(begins, many)
        s[y, x], r[y, x], w[y, x] = score, rank, row
        order = np.lexsort((r, -s), axis=-1)[:, : self.k]
        self.score[touched], self.rank[touched], self.row[touched] = (np.take_along_axis(v, order, 1) for v in (s, r, w))


def search_block(block: Block, terms: np.ndarray, times: np.ndarray, best: Best, rank: np.ndarray, row: np.ndarray, chosen: np.ndarray) -> int:
    """Improve ``best`` by the block's documents for the items ``chosen``; returns how many were scored.

    ``terms`` and ``times`` have an item's term numbers (-1: none) and their repeats in a row; ``rank`` the order of each
    document's id among all that ``best`` may hold, ``row`` the number under which a hit is kept.
    """
    t, q = terms[chosen], times[chosen]
    used = np.where(t >= 0, t, 0)
    lo = np.where(t >= 0, block.places(used, np.int64(0)), 0)
    hi = np.where(t >= 0, block.places(used + 1, np.int64(0)), 0)
    item, left = chosen, np.zeros(len(chosen), np.int64)
    right = np.full(len(chosen), block.documents, np.int64)
    scored = 0

    def bounded(item, left, right, lo, hi):
        """Intervals that may hold a hit, with bounds and the documents to split at."""
        at = block.maxima(lo, hi)
        share = np.where(at >= 0, block.value[at], 0) * times[item]
        bound = share.sum(1)
        split = block.doc[at[np.arange(len(item)), share.argmax(1)]] if len(item) else left
        last, edge = best.score[item, -1], best.rank[item, -1]
        live = (bound > 0) & ((bound > last) | ((bound == last) & (rank[np.minimum(left, block.documents - 1)] < edge)))
        return [v[live] for v in (item, left, right, lo, hi, bound, split)]

    queue = bounded(item, left, right, lo, hi)
    while len(queue[0]):
        item, left, right, lo, hi, bound, split = queue
        # what the hits so far rule out goes; of the rest each item's highest bounds are split
        last, edge = best.score[item, -1], best.rank[item, -1]
        live = np.flatnonzero((bound > last) | ((bound == last) & (rank[left] < edge)))
        order = live[np.lexsort((left[live], -bound[live], item[live]))]
        if not len(order):
            break
        begins = np.flatnonzero(np.diff(item[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        first = place < AT_ONCE
        now, later = order[first], order[~first]
        item, left, right, lo, hi, split = (v[now] for v in (item, left, right, lo, hi, split))
        wanted = terms[item]
        used = np.where(wanted >= 0, wanted, 0)
        at = np.clip(block.places(used, split[:, None]), lo, hi)
        here = (at < hi) & (block.doc[np.minimum(at, len(block.doc) - 1)] == split[:, None])
        value = np.where(here, block.value[np.minimum(at, len(block.doc) - 1)], 0) * times[item]
        scored += len(item)
        best.add(item, value.sum(1), rank[split], row[split])
        rests = bounded(np.concatenate([item, item]), np.concatenate([left, split + 1]), np.concatenate([split, right]), np.concatenate([lo, at + here]), np.concatenate([at, hi]))
        queue = [np.concatenate([old[later], new]) for old, new in zip(queue, rests)]
    return scored


def _items(texts: list[bytes], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and repeats of each item, as rows of one width."""
    found = [Counter(number[t] for t in terms_of(x) if t in number) for x in texts]
    width = max(1, max(map(len, found), default=1))
    terms, times = np.full((len(texts), width), -1, np.int64), np.zeros((len(texts), width), np.int64)
    for i, c in enumerate(found):
        terms[i, : len(c)], times[i, : len(c)] = list(c), list(c.values())
    return terms, times


def _search(index: DataFrame, texts: list[bytes], vocabulary: list[bytes], weights: np.ndarray, documents: int, length: int, k: int, postings: int) -> DataFrame:
    """(item, doc_id, score): the k best of every task for each item, numbered as in ``texts``."""
    number = {t: i for i, t in enumerate(vocabulary) if weights[i] > 0}
    shipped = index.sparkSession.sparkContext.broadcast((*_items(texts, number), weights))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", index.schema["doc_id"].dataType), T.StructField("score", T.LongType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                size += len(part.column("terms").flatten())
                if size >= postings:
                    yield lists(held)
                    held, size = [], 0
        if held:
            yield lists(held)

    def lists(held):
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(b.num_rows for b in held) else held[0]
        terms = table.column("terms")
        many = np.diff(np.asarray(terms.offsets))
        return table.column("doc_id"), np.asarray(table.column("n")), many, np.asarray(terms.flatten()), np.asarray(table.column("tf").flatten())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, times, weight = shipped.value
        best, ids = Best(len(texts), k), None
        step = max(1, CELLS // (terms.shape[1] * AT_ONCE))
        for doc_id, n, many, term, tf in blocks(batches):
            # ids of the hits so far and of this block get their common order; a null comes first
            both = doc_id if ids is None else pa.concat_arrays([ids, doc_id])
            order = np.asarray(pc.sort_indices(both, null_placement="at_start"))
            place = np.empty(len(both), np.int64)
            place[order] = np.arange(len(both))
            old = len(both) - len(doc_id)
            best.rank = np.where(best.row >= 0, place[np.maximum(best.row, 0)], np.iinfo(np.int64).max)
            mine = np.argsort(place[old:], kind="stable")  # documents of the block by id
            at = np.empty(len(mine), np.int64)
            at[mine] = np.arange(len(mine))
            own = np.repeat(np.arange(len(many)), many)
            value = impact(weight[term], tf, n[own], documents, length)
            block = Block(term, at[own], value, len(many))
            for a in range(0, len(terms), step):
                search_block(block, terms, times, best, place[old:][mine], old + mine, np.arange(a, min(a + step, len(terms))))
            kept, best.row = _keep(best.row)
            ids = both.take(pa.array(kept))
        if ids is not None:
            item, column = np.nonzero(best.row >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids.take(pa.array(best.row[item, column])), pa.array(best.score[item, column], pa.int64())], schema.names)

    return index.mapInArrow(work, schema)


def _keep(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are still in use, and ``row`` in terms of these."""
    kept = np.unique(row[row >= 0])
    return kept, np.where(row >= 0, np.searchsorted(kept, row), -1)


def search(items: DataFrame, docs: DataFrame, k: int = TOP_K, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text", item_bytes: int = ITEM_BYTES, postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each item."""
    spark = items.sparkSession
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    size = wanted.agg(F.sum(F.length("text"))).head()[0] or 0
    parts = max(1, math.ceil(2 * size / item_bytes)) if size > item_bytes else 1
    schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for p in range(parts):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else wanted
        rows = sorted(((bytes(r.text), r.item_id) for r in block.collect()), key=lambda r: (r[0], r[1] is not None, r[1]))
        texts = [t for t, _ in rows]
        vocabulary = sorted({t for x in texts for t in terms_of(x)})
        index = written(term_counts(docs, vocabulary, doc_id, text), "lexical-index")
        total = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).head()
        if not total.n or not vocabulary:
            continue
        frequency = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each term of the items
            frequency[r.t] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * df + 1))) if df else 0 for df in frequency.tolist()], np.int64)
        hits = _search(index, texts, vocabulary, weights, total.n, total.terms, k, postings)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.LongType()), schema["item_id"]]))
        out = out.unionByName(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # the items of one block
    return out
