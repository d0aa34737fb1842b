"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous rounds.

1. Tasks tokenise the documents, add the end token and cut what is longer than a sequence; one row per piece is
   written to the shared folder (lengths and checksums, no tokens unless asked for).
2. Rounds go down the lengths. In a round all pieces of one length ask at once for the gap that fits best: gaps
   are in order of size, and the sweep goes from the smallest successor upward. Pieces that want the same gaps are
   told apart by rank: the k-th piece gets the k-th place. Gaps shrink, pieces without one open new sequences, and
   the next round begins. This equals best-fit-decreasing placed one by one.
3. Pieces of one length, and gaps of one size, are interchangeable. So the rounds work on counts (at most
   ``capacity`` lengths and sizes, whatever the corpus), and yield runs: ranks a..b of a length go to sequences
   c..c+b-a at an offset. Ranks come from a salted count (a length that a third of all pieces have is dealt to many
   tasks), and one range lookup per piece gives its place.

Nothing but the counts per length reaches the driver: at most ``capacity`` rows.

Nulls: a null text is empty and packs as its end token alone. A null ``doc_id`` stays null. Repeated rows are packed
each on its own. Very long texts are cut into pieces of ``capacity`` tokens, each a full sequence. An empty table gives
an empty result. Other columns of the input are not carried, so names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, giving_back, kept_by, written

CAPACITY = 4096
#: pieces of one length that a task ranks
RANK_ROWS = 1_000_000
#: words as written, and words in lower case without end marks, whose ids a Python worker remembers (about 60 and 30 MB)
REMEMBERED, REMEMBERED_BASES = 1_000_000, 150_000
#: bytes of a word that the table of words holds; longer ones are learnt each time
WORD_BYTES = 16
END_MARKS = ".,!?;:"
_SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


class _Words:
    """Ids of words of at most ``WORD_BYTES`` bytes, none of them zero, with open addressing over arrays.

    A word is its bytes in two numbers, so that words are compared as a whole.
    """

    def __init__(self, most: int):
        bits = (2 * most - 1).bit_length()
        self.most, self.many, self.used = most, 0, 0
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.low, self.high = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.at, self.size = np.zeros(1 << bits, dtype=np.uint32), np.zeros(1 << bits, dtype=np.uint16)
        self.ids = np.zeros(1 << 16, dtype="<u4")

    def _first(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xD1342543DE82EF95))) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slots of the words; unknown ones get an empty slot."""
        slot = self._first(low, high)
        there = self.low[slot]
        open_ = np.flatnonzero((there != 0) & ((there != low) | (self.high[slot] != high)))
        while len(open_):
            at = (slot[open_] + np.uint64(1)) & self.mask
            slot[open_] = at
            there = self.low[at]
            open_ = open_[(there != 0) & ((there != low[open_]) | (self.high[at] != high[open_]))]
        return slot

    def hold(self, ids: np.ndarray) -> int:
        """Puts ids behind those of the remembered words, until the next call, and says where."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used // 2 + len(ids), dtype="<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        return self.used

    def remember(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Keeps different new words whose ids are held, the first of them first, while there is room."""
        n = min(len(low), self.most - self.many)
        if n <= 0:
            return
        slot, left = self._first(low[:n], high[:n]), np.arange(n)
        while len(left):
            free = left[self.low[slot[left]] == 0]
            want, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.low[want], self.high[want], self.at[want], self.size[want] = low[put], high[put], at[put], size[put]
            left = left[(self.low[slot[left]] != low[left]) | (self.high[slot[left]] != high[left])]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
        self.many, self.used = self.many + n, int(at[n - 1] + size[n - 1])


class WordEncoder:
    """Ids of texts by their words, for tokenizers whose tokens never cross white space and drop it.

    Ids of a text are then those of its words in a row, and words met before are looked up. A new word is looked up
    again in lower case and without end marks; where that is not certain to give the same ids, the tokenizer is asked.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.known = _Words(REMEMBERED)
        self.bases: dict[str, bytes] = {}
        state = json.loads(self.tokenizer.to_str())
        suffix = state["model"].get("end_of_word_suffix") or ""
        # a lower-casing tokenizer gives a word and its lower case the same ids
        self.lowers = any(x.get("type") == "Lowercase" for x in (state.get("normalizer") or {}).get("normalizers", []))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _parts(self, words: list[bytes]) -> list[tuple[str, str]]:
        """Each word as letters and the end marks after them; ``(word, "")`` where that would not be certain."""
        text = b"\n".join(words).decode()
        low = text.lower()
        # lower-casing a capital sigma depends on its place; other forms than NFC change in the tokenizer
        if not self.lowers or "\u03a3" in text or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
            return [(w, "") for w in text.split("\n")] if len(words) == 1 or not self.lowers else [p for w in words for p in self._parts([w])]
        lines = low.split("\n")
        bodies = [x.rstrip(END_MARKS) for x in lines]
        return [(b, x[len(b) :]) if b.isalpha() else (w.decode(), "") for b, x, w in zip(bodies, lines, words)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words; those of letters only are one unit of the tokenizer each and go to it in one line."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha()] if self.ends.any() else []
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.batch([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some):
                raw, cut = ids.tobytes(), (last * 4).tolist()
                out.update((w, raw[a:b]) for w, a, b in zip(some, [0, *cut], cut))
        rest = [w for w in words if w not in out]
        out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, self.batch(rest, add_special_tokens=False) if rest else []))
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words that are not known as written."""
        bases, parts = self.bases, self._parts(words)
        learnt = self._learn(list({p for pair in parts for p in pair if p and p not in bases}))
        bases.update(learnt)
        out = [bases[a] + bases[b] if b else bases[a] for a, b in parts]
        if len(bases) > REMEMBERED_BASES:
            for w in learnt:
                del bases[w]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        known = self.known
        # words end at spaces, tabs and line ends only: further white space is the tokenizer's matter
        raw = b" ".join([b"", *texts, b" " * WORD_BYTES])
        data = np.frombuffer(raw, dtype=np.uint8)
        space = _SPACES[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        length = ends - starts
        eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1), writeable=False)
        part = lambda at, size: eight[at].view("<u8").ravel().astype(np.uint64, copy=False) & _LOW_BYTES[np.clip(size, 0, 8)]
        low, high = part(starts, length), part(starts + 8, length - 8)
        short = length <= WORD_BYTES
        if b"\0" in raw:
            short[np.searchsorted(starts, np.flatnonzero(data == 0), "right") - 1] = False
        slot = known.slots(low, high)
        at, size = known.at[slot].astype(np.int64), known.size[slot].astype(np.int64)
        new = np.flatnonzero((known.low[slot] == 0) | ~short)
        if len(new):
            words = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            first: dict[bytes, int] = {}
            which = np.array([first.setdefault(w, len(first)) for w in words])
            place = np.zeros(len(first), dtype=np.int64)
            place[which[::-1]] = new[::-1]
            found = self._ids(list(first))
            # those that can be remembered stand first
            turn = np.argsort(~short[place], kind="stable")
            found_at, found_size = np.zeros(len(first), dtype=np.int64), np.array([len(x) // 4 for x in found])
            held = known.hold(np.frombuffer(b"".join([found[i] for i in turn.tolist()]), "<u4"))
            found_at[turn] = held + np.cumsum(found_size[turn]) - found_size[turn]
            keep = turn[: int(short[place].sum())]
            at[new], size[new] = found_at[which], found_size[which]
            known.remember(low[place[keep]], high[place[keep]], found_at[keep], found_size[keep])
        before = np.concatenate([[0], np.cumsum(size)])
        ids = known.ids[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        begin = np.cumsum([1] + [len(x) + 1 for x in texts])
        cut = before[np.searchsorted(starts, begin)].tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]


def encoder(path: str) -> WordEncoder:
    encoders = kept_by("packing")
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


_PIECE = T.StructType(
    [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (binary)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *_PIECE.fields] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for part, texts in byte_slices(batches, "text"):
            keys, out = part.column("doc_id"), ([], [], [], [], [], [])
            for row, ids in enumerate(encoder(tokenizer).encode(texts)):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    data = ids[at : at + capacity]
                    raw = data.tobytes()
                    for column, value in zip(out, (row, k, at, len(data), zlib.crc32(raw), raw if with_ids else None)):
                        column.append(value)
            arrays = [keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[5], pa.binary())] * with_ids, names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(giving_back(cut), schema)


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best fit over counts per length.

    Gives runs ``(length, first rank, last rank, first sequence, offset, per sequence)``: the pieces of this length from
    the first to the last rank fill, ``per sequence`` at a time, the sequences from the first one on.
    """
    runs, gaps, order, opened = [], {}, [], 0  # gaps: size -> runs of sequences (first, how many)

    def leave(size: int, first: int, many: int) -> None:
        if size and many:
            if size not in gaps:
                gaps[size] = []
                heapq.heappush(order, size)
            gaps[size].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank, skipped = counts[length], 0, []

        def fill(first: int, many: int, size: int) -> None:
            """Put pieces into sequences with a gap of this size, the most that fit into each before the next."""
            nonlocal left, rank
            each = size // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, rank + full * each - 1, first, capacity - size, each))
                leave(size - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < many:
                runs.append((length, rank, rank + left - 1, first + full, capacity - size, left))
                leave(size - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(size, first + full, many - full)

        while left and order:
            size = heapq.heappop(order)
            if size < length:
                skipped.append(size)
                continue
            for first, many in gaps.pop(size):
                if left:
                    fill(first, many, size)
                else:
                    leave(size, first, many)
        for size in skipped:
            heapq.heappush(order, size)
        if left:
            many = -(-left // (capacity // length))
            first, opened = opened, opened + many
            fill(first, many, capacity)
    return runs


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (the result of ``pieces``, read twice: write it first) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    sizes = {r.length: r["count"] for r in found.groupBy("length").count().collect()}
    runs = best_fit_runs(sizes, capacity)
    salts = max(1, -(-sum(sizes.values()) // RANK_ROWS))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count().select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # at most a few runs per length and gap size: their number is bounded by the capacity, not by the corpus
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0, 1)], "length long, first long, last long, sequence long, offset long, each long")
    table = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "last", "sequence", "offset", "each"))).alias("runs"))
    hit = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") <= r["last"])), 1)
    placed = ranked.join(table, "length").withColumn("run", hit)
    step = F.col("rank") - F.col("run.first")
    return placed.select(
        *found.columns,
        (F.col("run.sequence") + F.floor(step / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.offset") + (step % F.col("run.each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents as pieces with their places in sequences; with ``with_ids`` the token ids as well."""
    return pack(written(pieces(docs, tokenizer, end_id, capacity, doc_id, text, with_ids), "pieces"), capacity)
