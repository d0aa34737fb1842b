"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items is small and travels to the tasks; the corpus streams past it and never moves.
While a document's words stream through, the automaton gives the longest match that ends at each word. A match
of ``n`` words or more is an occurrence of a window of ``n`` consecutive item words; an item of fewer words is
one window of its own. Words of such matches are hit.

Most text has no window at all. Rolling hashes over whole batches find where one can be (a necessary condition
only: no window is missed), and the automaton then decides on the unbroken runs of item words around it.

Bounds: the items are dealt over automata of at most ``shard_bytes`` of text each, so what is sent to tasks is
bounded whatever the benchmark's size; documents pass one automaton after the other.

Nulls: a null text has no words; a null item text has no window; a null ``item_id`` counts as ``""``.
Repeated rows: each document row gets its own result; items with equal text are all reported; an ``item_id``
that occurs on several rows counts once. Empty tables give empty results, an empty benchmark gives no hit.
Other columns stay untouched; result columns replace columns of the same name.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, back, byte_slices, kept_by, written

#: text of benchmark items in one automaton
SHARD_BYTES = 8 << 20
#: automata in one pass over the documents; a further pass reads the written result of the last
SHARDS_PER_PASS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd factors of the rolling hashes
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, or of its inverse."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 12), pow(base, -1, 1 << 64) if inverse else base, dtype=np.uint64)
        factors[0] = 1
        have = _POWERS[base, inverse] = np.cumprod(factors)
    return have[:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums with which ``_hashes`` gives the hash of any stretch."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=out[1:])
    return out


def _hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    return (sums[last] - sums[first]) * _powers(base, len(sums), inverse=True)[first]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes in the texts joined by line ends, and the number of the first word of each text."""
    low = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(_IS_WORD[low].view(np.int8), prepend=np.int8(0)))
    first, last = edge[0::2], edge[1::2]
    at = np.cumsum([0] + [len(x) + 1 for x in texts])
    return first, last, _hashes(_sums(low.astype(np.uint64), _BASE), first, last, _BASE), np.searchsorted(first, at)


class Automaton:
    """Generalised suffix automaton over word numbers, built one item at a time."""

    def __init__(self, n: int):
        self.n, self.next, self.link, self.length = n, [{}], [-1], [0]
        self.items: list[set[str]] = [set()]  # items whose windows end in this state

    def _add(self, last: int, c: int) -> int:
        goes, link, length = self.next, self.link, self.length
        if c in goes[last]:
            q = goes[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, goes: dict[int, int], link: int) -> int:
        self.next.append(goes)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def insert(self, words: list[int]) -> None:
        last = 0
        for c in words:
            last = self._add(last, c)

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = length = 0
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield state, length

    def window(self, state: int, m: int) -> int:
        """The state of the last ``m`` words of a match that is at least as long."""
        while self.length[self.link[state]] >= m:
            state = self.link[state]
        return state


class Matcher:
    """The automaton of one shard of items with the hash tables that say where to look."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.n = n
        first, _, hashes, bounds = words_of([x for _, x in items])
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.automaton = auto = Automaton(n)
        rows = [(key, ids[a:b].tolist()) for (key, _), a, b in zip(items, bounds, bounds[1:]) if b > a]
        for _, words in rows:
            auto.insert(words)
        auto.items = [set() for _ in auto.next]
        lengths = set()
        for key, words in rows:
            m = min(n, len(words))
            lengths.add(m)
            for i, (state, length) in enumerate(auto.stream(words)):
                if length >= m and i >= m - 1:
                    auto.items[auto.window(state, m)].add((m, key))
        self.lengths = sorted(lengths)
        self.windows = {m: np.unique(np.concatenate([self._grams(np.array(w, dtype=np.int64), m) for _, w in rows if min(n, len(w)) == m])) for m in self.lengths}

    def _grams(self, ids: np.ndarray, m: int) -> np.ndarray:
        at = np.arange(max(0, len(ids) - m + 1))
        return _hashes(_sums(ids.astype(np.uint64) + np.uint64(1), _STEP), at, at + m, _STEP)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def runs(self, ids: np.ndarray, breaks: np.ndarray) -> list[tuple[int, int]]:
        """Unbroken runs of item words, within one text, that may hold a window."""
        inside = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        cut = np.unique(np.concatenate([edge, breaks[np.concatenate([ids, [-1]])[breaks] >= 0]]))
        first, last = cut[:-1], cut[1:]
        keep = ids[first] >= 0 if len(first) else np.zeros(0, bool)
        first, last = first[keep], last[keep]
        maybe, sums = np.zeros(len(ids) + 1, dtype=np.int64), _sums(np.maximum(ids, 0).astype(np.uint64) + np.uint64(1), _STEP)
        for m in self.lengths:
            starts = _stretches(first, last - m + 1)
            if len(starts):
                grams = _hashes(sums, starts, starts + m, _STEP)
                table = self.windows[m]
                at = np.minimum(np.searchsorted(table, grams), len(table) - 1)
                maybe[starts[table[at] == grams] + 1] = 1
        seen = np.cumsum(maybe)
        return [(a, b) for a, b in zip(first.tolist(), last.tolist()) if seen[b] > seen[a]]

    def hits(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word stretches inside occurrences of windows, and the items these belong to."""
        auto, spans, found = self.automaton, [], set()
        for i, (state, length) in enumerate(auto.stream(words)):
            for m in self.lengths:
                if m > length:
                    break
                keys = {key for k, key in auto.items[auto.window(state, m)] if k == m}
                if keys:
                    found |= keys
                    spans.append((i - m + 1, i + 1))
        return spans, found


def _stretches(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the half-open stretches, which are in order."""
    count = np.maximum(last - first, 0)
    total = int(count.sum())
    return np.arange(total) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if total else np.zeros(0, np.int64)


_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPAN), T.StructField("hit_items", T.ArrayType(T.StringType()))])


def _pass(docs: DataFrame, items, n: int, text: str) -> DataFrame:
    schema = T.StructType([f for f in docs.schema if f.name != "found"] + [T.StructField("found", _FOUND)])
    shared, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = kept_by("decontaminate")
        if token not in matchers:
            while len(matchers) >= SHARDS_PER_PASS:
                del matchers[next(iter(matchers))]
            matchers[token] = Matcher(shared.value, n)
        matcher = matchers[token]
        for part, texts in byte_slices(batches, text):
            _, _, hashes, bounds = words_of(texts)
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            keys: list[set[str]] = [set() for _ in texts]
            before = part.column("found").to_pylist() if "found" in part.schema.names else [None] * len(texts)
            ids = matcher.known(hashes)
            for a, b in matcher.runs(ids, bounds):
                doc = int(np.searchsorted(bounds, a, side="right")) - 1
                got, items_found = matcher.hits(ids[a:b].tolist())
                spans[doc] += [(x + a - int(bounds[doc]), y + a - int(bounds[doc])) for x, y in got]
                keys[doc] |= items_found
            rows = [
                {
                    "n_words": int(bounds[i + 1] - bounds[i]),
                    "hit_spans": [{"first": x, "last": y} for x, y in _merged(spans[i] + [(s["first"], s["last"]) for s in (old or {}).get("hit_spans", [])])],
                    "hit_items": sorted(keys[i] | set((old or {}).get("hit_items", []))),
                }
                for i, old in enumerate(before)
            ]
            columns = [part.column(f.name) for f in schema if f.name != "found"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _ARROW_FOUND)], names=schema.names)

    return docs.mapInArrow(scan, schema)


_ARROW_FOUND = pa.struct(
    [("n_words", pa.int64()), ("hit_spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("hit_items", pa.list_(pa.string()))]
)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` (word numbers, end exclusive, disjoint) and ``hit_items``.

    One pass over the documents without a shuffle for each ``SHARDS_PER_PASS`` shards of the benchmark.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("key"), F.col(item_text).cast("binary").alias("item")).where("item IS NOT NULL")
    size = items.agg(F.sum(F.length("item"))).head()[0] or 0
    shards = max(1, math.ceil(2 * size / shard_bytes)) if size > shard_bytes else 1
    out, to = aside(docs.drop("n_words", "n_hit", "hit_spans", "hit_items"), "found")
    for s in range(shards):
        part = items.where(F.pmod(F.xxhash64("key", "item"), F.lit(shards)) == s) if shards > 1 else items
        out = _pass(out, [(r.key, bytes(r.item)) for r in part.collect()], n, text)
        if s % SHARDS_PER_PASS == SHARDS_PER_PASS - 1 and s < shards - 1:
            out = written(out, "benchmark-hits")
    covered = F.aggregate("found.hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"]))
    own = [F.col(c).alias(next((old for old, new in to.items() if new == c), c)) for c in out.columns if c != "found"]
    return out.select(*own, F.col("found.n_words").alias("n_words"), covered.alias("n_hit"), F.col("found.hit_spans").alias("hit_spans"), F.col("found.hit_items").alias("hit_items"))


def contaminated(n_hit="n_hit", n_words="n_words", share: int = 20):
    """True where hit words make up at least one in ``share`` of all words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, text: str = "text", chars: str | None = None) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``; hit spans of ``n`` words are cut out of them.

    ``chars`` names a column with the number of letters of the text, which follows a cut.
    """
    own, to = aside(docs, "n_words", "n_hit", "hit_spans", "hit_items")
    kept = cut_spans(benchmark_hits(own, benchmark, n, text).where(~contaminated(share=share)), n, text)
    if chars is not None:
        cut = F.exists("hit_spans", lambda s: s["last"] - s["first"] >= n)
        kept = kept.withColumn(chars, F.when(cut, F.length(text).cast(docs.schema[chars].dataType)).otherwise(F.col(chars)))
    return back(kept, docs.columns, to)


def cut_spans(hits: DataFrame, min_words: int = 13, text: str = "text") -> DataFrame:
    """The result of ``benchmark_hits`` with every hit span of at least ``min_words`` words cut out of the text.

    Cut from the first letter of the span's first word to the last letter of its last word; nothing else changes.
    """
    cut = F.udf(lambda x, spans: _without(x, spans), "string")
    spans = F.filter("hit_spans", lambda s: s["last"] - s["first"] >= min_words)
    return hits.withColumn(text, F.when(F.size(spans) == 0, F.col(text)).otherwise(cut(F.when(F.size(spans) > 0, F.col(text)), spans)))


def _without(text: str | None, spans: list) -> str | None:
    """The text without the stretches of words, in one walk over its words."""
    if text is None or not spans:
        return text
    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["first"]][0]])
        at = words[s["last"] - 1][1]
    return "".join([*out, text[at:]])
