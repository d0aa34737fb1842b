"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of ASCII letters and digits and of bytes above 127, in lower case. Its subwords are its byte n-grams of 3 to 6
bytes with a mark at either end, and the whole word; each has an embedding, found by hash in a table of fixed size.
A word is the average of its subwords, a stretch of ``STRETCH`` words in a row the average of its words, and a softmax over two linear
scores gives the stretch's probability of being toxic. A text is as toxic as its most toxic stretch, so a few words weigh the
same in a long text as in a short one. Misspelt words share most subwords with the words they come from.

Training: embeddings and softmax weights together, by AdaGrad over mini-batches. The first passes give each stretch the label of
its text; the later ones take the most toxic stretch of each text under the model so far (multiple-instance learning).
Since a stretch enters the softmax linearly, gradients are sums per subword and no stretch is ever held as a matrix.

The model is fitted on a bounded sample of labelled texts: at most ``per_class`` different texts of each label and ``sample_bytes``
bytes in all, taken in the order of a hash of the text. Scoring is one pass over all texts with a table of one number per
subword; nothing is shuffled. Null and empty texts have no words and get the score of the bias alone; without any label of one
of the classes every score is 0. Labels that are null or have no document are not used; a document with several labels is
toxic if one of them says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, written

#: words in one stretch
STRETCH = 3
#: lengths of the n-grams of a word, in bytes, with the marks at its ends
GRAMS = (3, 4, 5, 6)
#: subwords are told apart by so many bits of their hash
BITS = 20
#: numbers in one embedding
WIDTH = 8
#: subwords of fewer texts of the sample are not learnt
LEAST_TEXTS = 3
#: largest training sample: different texts of each label, and bytes of text
PER_CLASS = 1500
SAMPLE_BYTES = 16 << 20

_STEP = np.uint32(16777619)
_MIX = np.uint32(0x9E3779B1)
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Model(NamedTuple):
    """``embeddings`` of the subwords, softmax ``weights`` (2 x width) and ``bias`` (2)."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def subword_scores(self) -> tuple[np.ndarray, float]:
        """Each subword's share in the difference of the two linear scores, and the difference of the biases."""
        return self.embeddings @ (self.weights[1] - self.weights[0]), float(self.bias[1] - self.bias[0])


def _squash(x: np.ndarray) -> np.ndarray:
    """The softmax probability of the second of two scores that differ by ``x``."""
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


class Subwords(NamedTuple):
    """Words and subwords of texts laid end to end; ``data`` has a blank before, between and after them."""

    data: np.ndarray
    first: np.ndarray  # first byte of each word
    end: np.ndarray
    text: np.ndarray  # number of the text of each word


def split_words(texts: list[bytes]) -> Subwords:
    joined = b" " + b" ".join(texts).translate(_TABLE) + b" "
    data = np.frombuffer(joined, np.uint8)
    inside = data != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, end = edge[::2], edge[1::2]
    starts = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[: len(texts)]
    return Subwords(data, first, end, np.searchsorted(starts, first, side="right") - 1)


def subwords(words: Subwords) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, subword number) of the n-grams of each length, then of the whole words."""
    data, first, end, _ = words
    n = len(data)
    if not len(first):
        return
    wide = data.astype(np.uint32)
    # the word that a byte, or the blank before a word, belongs to
    owner = np.zeros(n, np.int32)
    owner[first - 1] = 1
    owner = np.cumsum(owner, dtype=np.int32) - 1
    last = end[owner.clip(0)] + 1  # just after the blank that ends the word
    valid = (owner >= 0) & (np.arange(n) < last)
    h = wide.copy()
    for k in range(2, min(max(GRAMS), n) + 1):
        h = h[: n - k + 1] * _STEP + wide[k - 1 :]
        if k in GRAMS:
            at = np.flatnonzero(valid[: n - k + 1] & (np.arange(n - k + 1) + k <= last[: n - k + 1]))
            yield owner[at], _bucket(h[at], k)
    # whole words: differences of one running hash
    longest = int((end - first).max())
    sums, power, at = np.zeros(len(first), np.uint32), np.uint32(1), first.copy()
    live = np.arange(len(first))
    for _ in range(longest):
        sums[live] = sums[live] * _STEP + wide[at[live]]
        at[live] += 1
        live = live[at[live] < end[live]]
        if not len(live):
            break
    yield np.arange(len(first), dtype=np.int32), _bucket(sums, 1)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint32(kind * 0x01000193 & 0xFFFFFFFF)) * _MIX
    h ^= h >> np.uint32(15)
    return ((h * _STEP) >> np.uint32(32 - BITS)).astype(np.int32)


def stretches(words: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch number of each word, text number of each stretch, and words in each stretch."""
    if not len(words.text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.diff(words.text, prepend=-1))
    place = np.arange(len(words.text)) - np.repeat(begins, np.diff(np.append(begins, len(words.text))))
    number = np.cumsum(place % STRETCH == 0) - 1
    return number, words.text[place % STRETCH == 0], np.bincount(number)


def _bags(words: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, subword, weight) of all subwords, and the text of each stretch; weights of a stretch add up to one."""
    number, text, size = stretches(words)
    pairs = list(subwords(words))
    if not pairs:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), text
    word, sub = np.concatenate([w for w, _ in pairs]), np.concatenate([s for _, s in pairs])
    many = np.bincount(word, minlength=len(words.first))
    at = number[word]
    return at, sub, 1.0 / (many[word] * size[at]), text


def text_scores(texts: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """Difference of the two scores of the most toxic stretch of each text; the bias for a text without words."""
    out = np.full(len(texts), -np.inf)
    words = split_words(texts)
    number, text, size = stretches(words)
    total, many = np.zeros(len(words.first)), np.zeros(len(words.first), np.int64)
    for word, sub in subwords(words):
        total += np.bincount(word, table[sub], len(total))
        many += np.bincount(word, minlength=len(many))
    if len(total):
        np.maximum.at(out, text, np.bincount(number, total / many) / size + bias)
    return np.where(np.isneginf(out), bias, out)


def train(texts: list[bytes], labels: np.ndarray, passes: int = 3, rounds: int = 3, rate: float = 0.3, least_texts: int = LEAST_TEXTS, seed: int = 7) -> Model:
    """Embeddings and softmax weights for texts labelled 0 and 1; both labels carry the same weight."""
    draw = np.random.default_rng(seed)
    embeddings = draw.uniform(-1, 1, (1 << BITS, WIDTH)) / WIDTH
    weights, bias = draw.uniform(-0.5, 0.5, (2, WIDTH)), np.zeros(2)
    past = [np.full(1 << BITS, 1e-8), np.full((2, WIDTH), 1e-8), np.full(2, 1e-8)]
    labels = np.asarray(labels)
    groups = [g for g in np.array_split(draw.permutation(len(texts)), max(1, sum(map(len, texts)) >> 18)) if len(g)]
    common = np.zeros(1 << BITS, np.int32)
    for g in groups:
        words = split_words([texts[i] for i in g])
        for word, sub in subwords(words):
            pairs = np.unique(words.text[word] << BITS | sub)
            common += np.bincount(pairs & (1 << BITS) - 1, minlength=1 << BITS).astype(np.int32)
    embeddings[common < least_texts] = 0
    learnt = common >= least_texts

    def step(at, sub, weight, target, importance):
        """One mini-batch of stretches."""
        nonlocal embeddings, weights, bias
        across = weights[1] - weights[0]
        table = embeddings @ across
        score = np.bincount(at, table[sub] * weight, len(target)) + bias[1] - bias[0]
        error = (_squash(score) - target) * importance
        per_subword = np.bincount(sub, error[at] * weight, 1 << BITS)
        used = np.flatnonzero((per_subword != 0) & learnt)
        pull = per_subword[used]
        toward = pull @ embeddings[used]
        past[0][used] += pull**2 * (across**2).mean()
        embeddings[used] -= rate * pull[:, None] * across / np.sqrt(past[0][used])[:, None]
        for k, sign in ((1, 1), (0, -1)):
            past[1][k] += toward**2
            weights[k] -= 0.1 * rate * sign * toward / np.sqrt(past[1][k])
            past[2][k] += error.sum() ** 2
            bias[k] -= rate * sign * error.sum() / np.sqrt(past[2][k])

    def balance(target: np.ndarray) -> np.ndarray:
        yes = target.sum()
        return np.where(target == 1, len(target) / max(2 * yes, 1), len(target) / max(2 * (len(target) - yes), 1)) / len(target)

    for _ in range(passes):
        for g in groups:
            at, sub, weight, text = _bags(split_words([texts[i] for i in g]))
            if len(text):
                target = labels[g][text].astype(float)
                step(at, sub, weight, target, balance(target))
    for _ in range(rounds):
        # the most toxic stretch of each text, then some passes over these alone
        bags = []
        table, shift = embeddings @ (weights[1] - weights[0]), bias[1] - bias[0]
        for g in groups:
            at, sub, weight, text = _bags(split_words([texts[i] for i in g]))
            if not len(text):
                continue
            score = np.bincount(at, table[sub] * weight, len(text)) + shift
            order = np.lexsort((-score, text))
            best = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
            renumbered = np.full(len(text), -1)
            renumbered[best] = np.arange(len(best))
            keep = renumbered[at] >= 0
            bags.append((renumbered[at[keep]], sub[keep], weight[keep], labels[g][text[best]].astype(float)))
        for _ in range(6):
            for k in draw.permutation(len(bags)):
                at, sub, weight, target = bags[k]
                step(at, sub, weight, target, balance(target))
    return Model(embeddings, weights, bias)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[bytes], np.ndarray]:
    """At most ``per_class`` different texts of each label and ``sample_bytes`` bytes in all, in the order of a hash of the text.

    Copies of a text count once. Sizes are looked at first and only texts that fit come to the driver.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    texts = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(F.col(text).cast("binary")).alias("__hash"), F.col(text).cast("binary").alias("__text")).where("__text IS NOT NULL")
    # hashes and sizes alone meet the labels; different texts by their hash
    sizes = texts.select("__id", "__hash", F.length("__text").alias("__bytes")).join(marks, "__id")
    sizes = written(sizes.groupBy("__label", "__hash").agg(F.max("__bytes").alias("__bytes")), "labelled-texts")
    picked: list[tuple[int, int]] = []
    for k in (0, 1):
        found = sizes.where(F.col("__label") == k).select("__hash", "__bytes").orderBy("__hash").limit(per_class)  # each task keeps its first ones
        room = sample_bytes // 2
        for r in found.collect():
            if r["__bytes"] <= room:
                room -= r["__bytes"]
                picked.append((k, r["__hash"]))
    if len({k for k, _ in picked}) < 2:
        return [], np.zeros(0, np.int64)
    wanted = docs.sparkSession.createDataFrame(picked, "__label int, __hash long")  # at most 2 * per_class rows
    texts = texts.join(F.broadcast(wanted), "__hash").groupBy("__label", "__hash").agg(F.min("__text").alias("__text"))
    rows = sorted((r["__hash"], r["__label"], bytes(r["__text"])) for r in texts.collect())
    return [t for _, _, t in rows], np.array([k for _, k, _ in rows], np.int64)


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic; 0 everywhere without a model."""
    kept = docs.drop(name)
    if model is None:
        return kept.withColumn(name, F.lit(0.0))
    shipped = docs.sparkSession.sparkContext.broadcast(model.subword_scores())  # 2 ** BITS numbers, whatever the corpus

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shipped.value
        for part, texts in byte_slices(batches, text):
            found = _squash(text_scores(texts, table, bias))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, name])

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model | None:
    """A model of the labelled texts, or None where one of the labels does not occur."""
    texts, marks = training_sample(docs, labels, **bounds)
    return train(texts, marks) if texts else None


def held_out(doc_id: Column, fold: int = 5) -> Column:
    """True for ids whose CRC-32, taken of the id as text, is a multiple of ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == 0, F.lit(False))
