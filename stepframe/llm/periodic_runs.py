"""Periodic runs: stretches of words that go on repeating one period, found by block convolution.

A run is a stretch of words with smallest period q that is at least ``max(least, 2 * q)`` words long and that no neighbouring
word extends. For the dyadic block lengths B = 2, 4, 8, ... periods from 2B - 1 to 4B - 2 are searched (from 1 for B = 2): the
matching part of such a run is long enough to hold a whole block that starts at a multiple of B. For every block the sums of
squared differences of word numbers at all these distances come from one exact convolution, a number-theoretic transform
modulo primes whose product is above the largest possible sum. A sum of zero is an occurrence of the block, and its distance is
a seed that is extended word by word to both sides. Blocks with a word that does not come again within the largest
distance are left out, since they cannot occur again.

One row is one unit of work: nothing is shuffled, and memory is bounded by the longest text. Texts are worked on in slices of
about a megabyte. A null or empty text has no words and no runs; columns of the input named like a new one are kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import byte_slices

#: Primes below 2**31 with a generator; p - 1 is a multiple of the power of two in the third place.
PRIMES = ((2013265921, 31, 27), (469762049, 3, 26), (998244353, 3, 23))
#: numbers in one transformed matrix
CELLS = 1 << 18
#: least length of a run, in words
LEAST = 12

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


@lru_cache(maxsize=64)
def _roots(prime: int, generator: int, size: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. size / 2 - 1 of a primitive ``size``-th root of one."""
    root = pow(generator, (prime - 1) // size, prime)
    root = pow(root, prime - 2, prime) if inverse else root
    out = np.ones(max(1, size // 2), np.int64)
    step, at = root, 1
    while at < len(out):  # doubling: the powers so far, times the next one
        out[at : 2 * at] = out[: len(out[at : 2 * at])] * step % prime
        step, at = step * step % prime, 2 * at
    return out


def _transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Each row's transform, in bit-reversed order."""
    m, size = rows.shape
    half = size // 2
    while half:
        pairs = rows.reshape(m, -1, 2, half)
        even, odd = pairs[:, :, 0], pairs[:, :, 1]
        low = (even + odd) % prime
        high = (even - odd) % prime * _roots(prime, generator, 2 * half, False) % prime
        rows = np.stack([low, high], axis=2).reshape(m, size)
        half //= 2
    return rows


def _back(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The inverse of ``_transform``."""
    m, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(m, -1, 2, half)
        even, odd = pairs[:, :, 0], pairs[:, :, 1] * _roots(prime, generator, 2 * half, True) % prime
        rows = np.stack([(even + odd) % prime, (even - odd) % prime], axis=2).reshape(m, size)
        half *= 2
    return rows * pow(size, prime - 2, prime) % prime


def squared_differences(blocks: np.ndarray, windows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Sum of squared differences of each block and every place in its window, modulo ``prime``."""
    (m, b), width = blocks.shape, windows.shape[1]
    size = 1 << (width - 1).bit_length()
    left, right = np.zeros((m, size), np.int64), np.zeros((m, size), np.int64)
    left[:, :b] = blocks[:, ::-1] % prime
    right[:, :width] = windows % prime
    # places b - 1 .. width - 1 of the cyclic product are free of wrapped terms, as size >= width
    products = _back(_transform(left, prime, generator) * _transform(right, prime, generator) % prime, prime, generator)[:, b - 1 : width]
    own = (left[:, :b] ** 2 % prime).sum(1) % prime
    so_far = np.zeros((m, width + 1), np.int64)
    np.cumsum(right[:, :width] ** 2 % prime, axis=1, out=so_far[:, 1:])
    return (own[:, None] + so_far[:, b:] - so_far[:, :-b] - 2 * products) % prime


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """True where a block equals the part of its window at that place; exact for numbers from 0 to the largest given."""
    top = int(max(blocks.max(initial=0), windows.max(initial=0)))
    size, most = 1 << (windows.shape[1] - 1).bit_length(), blocks.shape[1] * top * top
    same, product = None, 1
    for prime, generator, power in PRIMES:
        if size >> power:
            continue
        if same is None:
            same = squared_differences(blocks, windows, prime, generator) == 0
        else:  # what one prime leaves open is looked at again
            rows = np.flatnonzero(same.any(1))
            if not len(rows):
                return same
            same[rows] &= squared_differences(blocks[rows], windows[rows], prime, generator) == 0
        product *= prime
        if product > most:
            return same
    raise ValueError(f"no transform for blocks of {blocks.shape[1]} words")


def _next_same(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distance to the next equal word of the same text; a very large number where there is none."""
    out = np.full(len(ids), np.iinfo(np.int64).max, np.int64)
    order = np.lexsort((ids, doc))  # stable, so places rise
    here, after = order[:-1], order[1:]
    same = (ids[here] == ids[after]) & (doc[here] == doc[after])
    out[here[same]] = after[same] - here[same]
    return out


def _agree(ids: np.ndarray, x: int, y: int, most: int, step: int) -> int:
    """How many words from ``x`` and ``y`` on, at most ``most``, agree one by one; ``step`` 1 or -1."""
    done, width = 0, 32
    while done < most:
        n = min(width, most - done)
        if step > 0:
            differ = ids[x + done : x + done + n] != ids[y + done : y + done + n]
        else:
            differ = (ids[x - done - n + 1 : x - done + 1] != ids[y - done - n + 1 : y - done + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, width = done + n, width * 2
    return most


def _seeds(ids: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray, ahead: np.ndarray, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block starts, distances) at block length ``b``; of blocks in a row at one distance only the first."""
    low, high = (1 if b == 2 else 2 * b - 1), 4 * b - 2
    many = np.maximum((end - first - low) // b, 0)  # blocks with room for the least distance
    owner = np.repeat(np.arange(len(first)), many)
    starts = first[owner] + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * b
    lost = np.concatenate([[0], np.cumsum(ahead > high)])
    live = lost[starts + b] == lost[starts]
    starts, owner = starts[live], owner[live]
    width = high - low + b
    step = max(1, CELLS // (4 * b))
    for at in range(0, len(starts), step):
        s, limit = starts[at : at + step], end[owner[at : at + step]]
        places = s[:, None] + low + np.arange(width)
        windows = ids[np.minimum(places, len(ids) - 1)]
        found = occurrences(ids[s[:, None] + np.arange(b)], windows)
        found &= s[:, None] + low + np.arange(high - low + 1) + b <= limit[:, None]
        beside = np.zeros(len(s), bool)
        beside[1:] = (s[1:] - s[:-1] == b) & (doc[s[1:]] == doc[s[:-1]])
        fresh = found.copy()
        fresh[1:] &= ~(found[:-1] & beside[1:, None])
        if b == 2:  # at these distances six words at least match, and so two blocks in a row
            fresh[:-1] &= found[1:] & beside[1:, None]
        rows, columns = np.nonzero(fresh)
        yield s[rows], columns + low


def periodic_runs(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For texts laid end to end as word numbers: each one's runs as (start, length, period), by start, then period."""
    end = np.cumsum(lengths)
    first = end - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ahead = _next_same(ids, doc)
    known: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[tuple[int, int], int] = {}
    b, longest = 2, int(lengths.max(initial=0))
    while (1 if b == 2 else 2 * b - 1) + b <= longest:
        for starts, distances in _seeds(ids, doc, first, end, ahead, b):
            order = np.lexsort((distances, doc[starts])) if len(starts) else []
            starts, distances = starts[order], distances[order]
            for group in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(doc[starts])) + 1) if len(starts) else []:
                k = int(doc[starts[group[0]]])
                s, d = starts[group], distances[group]
                # inside a known run whose period divides the distance there is no other run of that distance
                new = np.ones(len(s), bool)
                for x, y, q in known.get(k, []):
                    if y - x >= 3 * b - 1:
                        new &= ~((s >= x) & (s + d + b <= y) & (d % q == 0))
                lo, hi = int(first[k]), int(end[k])
                for x, q in zip(s[new].tolist(), d[new].tolist()):
                    if seen.get((k, q), -1) > x:
                        continue
                    after = _agree(ids, x + b, x + q + b, hi - x - q - b, 1)
                    before = _agree(ids, x - 1, x + q - 1, x - lo, -1)
                    seen[k, q] = x + b + after
                    left, right = x - before, x + b + after + q
                    if right - left >= max(least, 2 * q):
                        known.setdefault(k, []).append((left, right, q))
        # places are only looked up again at the distances of one block length
        seen.clear()
        b *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    for k, found in known.items():
        smallest: dict[tuple[int, int], int] = {}
        for x, y, q in found:  # one stretch under several periods: the smallest is its own
            smallest[x, y] = min(q, smallest.get((x, y), q))
        out[k] = sorted((x - int(first[k]), y - x, q) for (x, y), q in smallest.items())
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, kept) if k])


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start word, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` has the words joined by one space, without those that a run holds after its first period. Words are
    stretches without ASCII white space. Earlier columns of these names are replaced.
    """
    names = ["n_words", "runs", "collapsed"]
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for part, texts in byte_slices(batches, text):
            words = [x.split() for x in texts]  # on bytes this cuts at ASCII white space only
            numbers: dict[bytes, int] = {}
            ids = np.array([numbers.setdefault(w, len(numbers)) for ws in words for w in ws], np.int64)
            runs = periodic_runs(ids, np.array([len(ws) for ws in words], np.int64), least)
            new = [
                pa.array([len(ws) for ws in words], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind),
                pa.array([_collapsed(ws, r).decode() for ws, r in zip(words, runs)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    return kept.mapInArrow(work, schema)
