"""Removal of byte strings of ``length`` that also start elsewhere, by column-wise multi-document construction.

Building one collection over a whole corpus takes as many rounds as its longest text has symbols, each over all
that was built so far. So the collection is cut into small ones that cannot tear a repeat apart:

1. Every string of ``length`` bytes has an anchor, the smallest of the hashes of its stretches of ``STRETCH`` bytes.
   Equal strings have the same anchor in the same place. Consecutive strings with one anchor form a chunk of less
   than ``2 * length`` bytes. Anchors that the corpus has once cannot be in a repeat and go no further.
2. Chunks with one anchor are lined up at it. Equal chunks are one with a count: all its strings are repeated.
   Different ones become a collection, built column by column from the right: each round inserts one symbol of every
   document, which turns the order of the suffixes of the last column into that of this one (a stable sort by the new
   symbol, as the transform's columns do), and updates the common prefixes of neighbours. A string is repeated where
   its common prefix with a neighbour reaches ``length``. Tasks build many collections at once, in memory, since
   chunks are short; these arrays stand for the external files of the method.
3. An anchor with more than ``group_rows`` different chunks is split by context: strings that start within ``STEPS``
   of each other share a core, by which their parts of the chunks are dealt to collections of their own; in the last
   step a part is a single string, and equal ones fall together. Nothing is capped or dropped.
4. What is repeated goes back to all places of the chunks, and texts lose the bytes covered.

Nulls: a null text is empty. Texts shorter than ``length`` keep everything. Very long texts have more chunks, periodic
ones many equal chunks, which are one. Repeated rows count as several places, like other copies. A null ``doc_id`` is
a value of its own. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, written
from .decontaminate import _hashes, _sums

LENGTH, STRETCH = 400, 32
#: different chunks that one task lines up at one anchor, and chunks that it builds at once
GROUP_ROWS, BATCH_ROWS = 8192, 4096
#: starts that share a core when a large group is split, step by step
STEPS = (16, 1)
_KEY, _CONTENT = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_AT = np.uint64((1 << 28) - 1)  # low bits of a stretch's rank: its place, so that the leftmost of equal ones is smallest


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values: minima from both ends of blocks of ``w``, combined."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


class Chunks:
    """Chunks of some texts: text number, first and last start, anchor (in the text), anchor key and content hash."""

    def __init__(self, texts: list[bytes], length: int, stretch: int):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        begin = np.cumsum([0] + [len(x) for x in texts])
        w = length - stretch + 1
        none = np.zeros(0, dtype=np.int64)
        self.text = self.first = self.last = self.anchor = none
        self.key = self.content = none.astype(np.uint64)
        if len(data) < length:
            return
        at = np.arange(len(data) - stretch + 1)
        hashes = _mix(_hashes(_sums(data, _KEY), at, at + stretch, _KEY))
        lowest = _window_minima((hashes & ~_AT) | at.astype(np.uint64), w)
        anchor = (lowest & _AT).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(begin))[: len(anchor)]
        real = np.arange(len(anchor)) + length <= begin[doc + 1]
        starts = np.flatnonzero(real)
        if not len(starts):
            return
        new = np.concatenate([[True], (anchor[starts[1:]] != anchor[starts[:-1]]) | (doc[starts[1:]] != doc[starts[:-1]])])
        first = starts[new]
        last = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
        self.text, at = doc[first], anchor[first]
        shift = begin[self.text]
        self.first, self.last, self.anchor = first - shift, last - shift, at - shift
        self.key = hashes[at]
        content = _hashes(_sums(data, _CONTENT), first, last + length, _CONTENT)
        # the anchor's place and the size belong to what makes chunks equal
        self.content = _mix(content + ((at - first) * 4096 + (last - first)).astype(np.uint64) * np.uint64(_KEY))


_OCCURRENCE = "doc_id {id}, text_hash long, first int, last int, anchor int, key long, content long"


def occurrences(rows: DataFrame, length: int, stretch: int) -> DataFrame:
    """Chunks of ``rows`` (``doc_id, text_hash, text``)."""
    schema = _OCCURRENCE.format(id=rows.schema["doc_id"].dataType.simpleString())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches):
            c = Chunks(texts, length, stretch)
            take = pa.array(c.text, pa.int64())
            places = [pa.array(x, pa.int32()) for x in (c.first, c.last, c.anchor)]
            hashes = [pa.array(x.view(np.int64)) for x in (c.key, c.content)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("text_hash").take(take), *places, *hashes], names=["doc_id", "text_hash", "first", "last", "anchor", "key", "content"])

    return rows.mapInArrow(scan, schema)


def build(chunks: list[bytes], lefts: np.ndarray, groups: np.ndarray, length: int, left_most: int) -> np.ndarray:
    """Which starts are repeated: a row per column from ``-left_most`` to 0, a column per chunk.

    ``groups`` are collection numbers in order; chunk ``i`` has its anchor at ``lefts[i]``.
    """
    m = len(chunks)
    size = np.array([len(c) for c in chunks])
    columns = left_most + length
    symbols = np.zeros((m, columns), dtype=np.uint16)  # zero: before the chunk or after it
    flat = np.frombuffer(b"".join(chunks), dtype=np.uint8)
    row = np.repeat(np.arange(m), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left_most - lefts, size)
    symbols[row, place] = flat.astype(np.uint16) + 1
    symbols = np.ascontiguousarray(symbols.T)
    high = groups.astype(np.int64) << 9
    order = np.arange(m)
    common = np.zeros(m + 1, dtype=np.int64)  # common prefix with the one before; the last is a stop
    found = np.zeros((left_most + 1, m), dtype=bool)
    for c in range(columns - 1, -1, -1):
        keys = high[order] | symbols[c][order]
        turn = np.argsort(keys, kind="stable")
        keys = keys[turn]
        # between two that now stand together with one symbol lie, in the old order, those with other symbols
        same = np.flatnonzero((keys[1:] == keys[:-1]) & (keys[1:] & 511 > 0)) + 1
        ends = np.empty(2 * len(same), dtype=np.int64)
        ends[0::2], ends[1::2] = turn[same - 1] + 1, turn[same] + 1
        updated = np.zeros(m + 1, dtype=np.int64)
        if len(same):
            updated[same] = np.minimum.reduceat(common, ends)[0::2] + 1
        order, common = order[turn], updated
        if c <= left_most:
            reach = np.maximum(common[:-1], common[1:])
            found[c, order[reach >= length]] = True
    return found


def _ranges(hit: np.ndarray, lo: int) -> list[dict[str, int]]:
    """Runs of true values as first and last number, counted from ``lo``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"a": int(a) + lo, "b": int(b) - 1 + lo} for a, b in zip(edge[0::2], edge[1::2])]


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def collections(parts: DataFrame, length: int, stretch: int) -> DataFrame:
    """``parts`` (``key, content, left, bytes``) in collections by key: ``key, content, starts`` from the anchor."""
    left_most = length - stretch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(keys, contents, lefts, chunks) -> pa.RecordBatch:
            found = build(chunks, lefts, np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])), length, left_most)
            starts = [_ranges(found[left_most - a : left_most + len(c) - length - a + 1, i], -a) for i, (a, c) in enumerate(zip(lefts.tolist(), chunks))]
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(contents), pa.array(starts, _RANGES)], names=["key", "content", "starts"])

        keys, contents, lefts, chunks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            contents = np.concatenate([contents, batch.column(1).to_numpy()])
            lefts = np.concatenate([lefts, batch.column(2).to_numpy().astype(np.int64)])
            chunks += batch.column(3).to_pylist()
            while len(keys) > BATCH_ROWS:
                edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                full = edge[edge <= BATCH_ROWS]
                cut = int(full[-1]) if len(full) else int(edge[0]) if len(edge) else 0
                if not cut:
                    break  # the first collection may go on in the next batch
                yield built(keys[:cut], contents[:cut], lefts[:cut], chunks[:cut])
                keys, contents, lefts, chunks = keys[cut:], contents[cut:], lefts[cut:], chunks[cut:]
        if len(keys):
            yield built(keys, contents, lefts, chunks)

    lined = parts.select("key", "content", "left", "bytes").repartition("key").sortWithinPartitions("key", "content")
    return lined.mapInArrow(run, "key long, content long, starts array<struct<a:int,b:int>>")


def _split(parts: DataFrame, length: int, step: int) -> DataFrame:
    """Parts of chunks by the core that ``step`` neighbouring starts share, under a new key and content hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                keys, contents, chunks = some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(3).to_pylist()
                out = [[] for _ in range(6)]
                for i, (left, chunk) in enumerate(zip(some.column(2).to_pylist(), chunks)):
                    lo, hi = -left, len(chunk) - length - left  # starts, from the anchor
                    for block in range(lo // step, hi // step + 1):
                        a, b = max(lo, block * step), min(hi, block * step + step - 1)
                        core = chunk[max(0, block * step + step - 1 + left) : block * step + length + left]
                        digest = hashlib.blake2b(core, digest_size=8, salt=int(keys[i]).to_bytes(8, "little", signed=True), person=block.to_bytes(8, "little", signed=True)).digest()
                        own = chunk[a + left : b + length + left]
                        inner = hashlib.blake2b(own, digest_size=8, person=(b - a).to_bytes(8, "little") + (a & 0xFFFF).to_bytes(8, "little")).digest()
                        for column, value in zip(out, (keys[i], contents[i], int.from_bytes(digest, "little", signed=True), int.from_bytes(inner, "little", signed=True), -a, own)):
                            column.append(value)
                types = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["above", "above_content", "key", "content", "left", "bytes"])

    return parts.select("key", "content", "left", "bytes").mapInArrow(cut, "above long, above_content long, key long, content long, left int, bytes binary")


def repeated_starts(parts: DataFrame, length: int = LENGTH, stretch: int = STRETCH, group_rows: int = GROUP_ROWS, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """``key, content, starts`` for different chunks (``key, content, left, bytes``; read twice: write them first)."""
    if not steps:
        return collections(parts, length, stretch)
    # written, so that the joins below read both sides from plain exchanges, where a hot key can be split
    sizes = written(parts.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "group-sizes")
    usual = parts.join(sizes.where(F.col("many") <= group_rows), "key", "left_semi")
    out = collections(usual, length, stretch)
    large = parts.join(sizes.where(F.col("many") > group_rows), "key", "left_semi")
    pieces = written(_split(large, length, steps[0]), "large-groups")
    if pieces.isEmpty():
        return out
    # equal parts are repeated as a whole; of the others one of each kind goes on
    kinds = written(pieces.groupBy("key", "content").agg(F.count("*").alias("many"), F.first("left").alias("left"), F.first("bytes").alias("bytes")), "large-groups")
    whole = F.array(F.struct((-F.col("left")).cast("int").alias("a"), (F.length("bytes") - length - F.col("left")).cast("int").alias("b")))
    equal = kinds.where("many > 1").select("key", "content", whole.alias("starts"))
    below = repeated_starts(kinds, length, stretch, group_rows, steps[1:]).where(F.size("starts") > 0)
    found = equal.unionByName(below).groupBy("key", "content").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    back = pieces.select("above", "above_content", "key", "content").join(found, ["key", "content"])
    return out.unionByName(back.groupBy(F.col("above").alias("key"), F.col("above_content").alias("content")).agg(F.flatten(F.collect_list("starts")).alias("starts")))


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, stretch: int = STRETCH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, text, text_hash, covered``: for every row, the byte ranges (end exclusive, may overlap) to remove."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = rows.where(F.octet_length("text") >= length)
    chunks = occurrences(long, length, stretch)
    often = written(chunks.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key"), "keys")
    chunks = written(chunks.join(often, "key", "left_semi"), "chunks")
    kinds = chunks.groupBy("key", "content").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "text_hash", "first", "last", "anchor")).alias("at"))
    kinds = written(kinds, "kinds")
    several = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    several = written(several, "keys")
    wanted = kinds.join(several, "key", "left_semi").groupBy("at.doc_id", "at.text_hash").agg(F.collect_list(F.struct("key", "content", "at.first", "at.last", "at.anchor")).alias("wanted"))
    parts = written(_fetch(long, wanted, length), "parts")
    starts = repeated_starts(parts, length, stretch, group_rows).where(F.size("starts") > 0)
    starts = starts.unionByName(kinds.where("many > 1").select("key", "content", F.array(F.struct((F.col("at.first") - F.col("at.anchor")).alias("a"), (F.col("at.last") - F.col("at.anchor")).alias("b"))).alias("starts")))
    hit = chunks.join(starts, ["key", "content"])
    ranges = F.transform("starts", lambda s: F.struct((s["a"] + F.col("anchor")).alias("a"), (s["b"] + F.col("anchor") + length).alias("b")))
    covered = hit.select("doc_id", "text_hash", ranges.alias("covered")).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("covered")).alias("covered"))
    covered = covered.withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    return rows.join(covered, rows["doc_id"].eqNullSafe(covered["hit_id"]) & (rows["text_hash"] == covered["hit_hash"]), "left").select("doc_id", "text", "text_hash", "covered")


def _fetch(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted chunks: ``key, content, left, bytes``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches):
            out = [[], [], [], []]
            for text, wants in zip(texts, part.column("wanted").to_pylist()):
                for w in wants:
                    for column, value in zip(out, (w["key"], w["content"], w["anchor"] - w["first"], text[w["first"] : w["last"] + length])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "content", "left", "bytes"])

    wanted = wanted.withColumnsRenamed({"doc_id": "want_id", "text_hash": "want_hash"})
    one = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["want_id"]) & (rows["text_hash"] == wanted["want_hash"]))
    found = one.select("text", "wanted").mapInArrow(cut, "key long, content long, left int, bytes binary")
    return found.dropDuplicates(["key", "content"])  # repeated rows of a document bring the same chunks


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``doc_id, kept`` (binary: what is left may be cut within a character), ``n_bytes, n_removed, n_spans, kept_sha256``."""
    found = repeated_bytes(docs, doc_id, text, **how)
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches):
            out = [[], [], [], [], []]
            for text, ranges in zip(texts, part.column("covered").to_pylist()):
                kept, at, spans, end = [], 0, 0, -1
                for a, b in sorted((r["a"], r["b"]) for r in ranges or []):
                    if a > end:
                        kept.append(text[at:a])
                        spans += 1
                    end = max(end, b)
                    at = end
                left = b"".join(kept) + text[at:]
                for column, value in zip(out, (left, len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest())):
                    column.append(value)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, t) for x, t in zip(out, types)]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.select("doc_id", "text", "covered").mapInArrow(strip, schema)
