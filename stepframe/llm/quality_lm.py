"""Quality by perplexity: an interpolated modified Kneser-Ney model of character n-grams per language.

1. Counting. Tasks count the n-grams of their trusted texts and emit each once; counts add up by hash of the n-gram.
   All trusted texts take part.
2. Estimation. Lower orders count distinct left neighbours; discounts come from counts of counts per language and
   order; contexts and suffixes meet their n-grams in joins sharded by the n-gram. Everything stays a table.
3. Scoring. The log-probability of a text is a sum over its n-grams of all orders: ``gain`` for a known n-gram and
   ``leave`` for a known context (the weight of backing off from it). So the weights can be dealt over shards of at
   most ``SHARD_ENTRIES`` n-grams by hash; each shard travels to the tasks as it is needed, and documents, which never
   move, pass one shard after the other.
4. Thresholds. One trusted text in ``HELD_OUT``, by a hash of the text so that copies stay together, is not counted
   but sets the threshold: per language, a quantile of the deviation from the mean log-perplexity. Short texts vary
   more, so deviations count in units of the square root of the length. A language with few held-out texts takes the
   quantile over all languages if that is larger.

Characters rather than words, because nearly every word sequence of a corpus is new: counts per word sequence would
be as large as the corpus, while character n-grams saturate.

Nulls: a null text is empty; an empty text has perplexity of its end alone. A null language is a language of its
own. Languages without trusted text have no model: perplexity and threshold are null and documents are kept. Null
labels do not count as trusted; a document with several labels is trusted if all say so. Very long texts are scored
whole. Repeated rows are scored each. Empty tables give empty results. Result columns replace columns of the same
name.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, giving_back, kept_by, written

ORDER = 5
#: n-grams in one table of weights: 16 bytes for each and up to 8 for where it begins, at most 72 MB a table
SHARD_ENTRIES = 3_000_000
#: tables in one pass over the documents
SHARDS_PER_PASS = 3
#: bytes of text scored at once: small arrays stay in the processor's cache
SLICE = 1 << 18
EDGE = 0x0A  # stands before and after every text
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with ``order - 1`` edges before it and one after it, and where they begin."""
    edge = chr(EDGE)
    joined = "".join([edge * (order - 1) + x.decode() + edge for x in texts])
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = [len(x.decode()) if not x.isascii() else len(x) for x in texts]
    return codes, np.cumsum([0] + [n + order for n in sizes])


def _spread_bits(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _FACTOR
    return h ^ (h >> np.uint64(29))


def _lang_seed(lang: str | None) -> int:
    out = 1469598103934665603 if lang is None else 14695981039346656037
    for b in (lang or "").encode():
        out = (out ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return out


def _keys(codes: np.ndarray, seeds: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For k = 1 .. order, the keys of the n-grams of k characters that end at each position from ``order - 1`` on."""
    n = len(codes) - order + 1
    h = seeds[order - 1 :].copy()
    for k in range(1, order + 1):  # characters are taken from the last to the first
        h = (h + codes[order - k : order - k + n] + np.uint64(1)) * _FACTOR
        h ^= h >> np.uint64(31)
        key = _spread_bits(h)
        key[key == 0] = 1  # zero is the empty slot
        yield key


def gram_key(lang: str | None, gram: str) -> int:
    """The key of one n-gram."""
    codes = np.array([ord(c) for c in gram], dtype=np.uint64)
    return int(list(_keys(codes, np.full(len(codes), _lang_seed(lang), np.uint64), len(codes)))[-1][-1])


def count_grams(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over all rows of ``trusted`` (``lang``, ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("quality_lm")
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def merged(lang):
            parts = held[lang]
            key, n, gram = (np.concatenate([p[i] for p in parts]) for i in range(3))
            key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            held[lang] = [(key, np.bincount(inverse, weights=n).astype(np.int64), gram[first])]

        def emit() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                merged(lang)
                _, n, gram = held.pop(lang)[0]
                for at in range(0, len(n), 50_000):
                    some = gram[at : at + 50_000]
                    text = some.astype("<u4").tobytes().decode("utf-32-le")
                    rows = [text[i : i + order] for i in range(0, len(text), order)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.string()), pa.array(n[at : at + 50_000])], names=["lang", "gram", "n"])

        for part, texts in byte_slices(batches, "text", SLICE * 4):
            langs = part.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                codes, begin = _codes([t for t, x in zip(texts, langs) if x == lang], order)
                *_, key = _keys(codes, np.full(len(codes), _lang_seed(lang), np.uint64), order)
                real = np.ones(len(key), dtype=bool)
                for back in range(1, order):  # n-grams that begin in one text and end in the next
                    real[np.maximum(begin[1:-1] - back, 0)] = False
                at = np.flatnonzero(real)
                got, first, n = np.unique(key[at], return_index=True, return_counts=True)
                grams = codes.astype(np.uint32)[at[first][:, None] + np.arange(order)]
                held.setdefault(lang, []).append((got, n, grams))
                if sum(len(p[0]) for p in held[lang]) > 600_000:
                    merged(lang)
            if sum(len(p[0]) for parts in held.values() for p in parts) > 2_000_000:
                yield from emit()
        yield from emit()

    rows = trusted.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(giving_back(count), "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def estimate(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Weights ``lang, gram, gain, leave`` for all orders, and for the empty n-gram what every position has in ``gain``."""
    grams = {order: written(counts, "grams")}
    for k in range(order - 1, 0, -1):
        # the highest order counts occurrences, the others distinct left neighbours
        shorter = F.substring("gram", 2, k)
        grams[k] = written(grams[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), "grams")
    below = grams[1].groupBy("lang").agg((1 / (F.count("*") + 1.0)).alias("p")).select("lang", F.lit("").alias("gram"), "p")
    known, leaves = below, None
    for k in range(1, order + 1):
        many = lambda i: F.sum(F.when(F.col("n") == i, 1.0).otherwise(0.0))  # noqa: B023, E731
        c = grams[k].groupBy("lang").agg(*[many(i).alias(f"c{i}") for i in (1, 2, 3, 4)])
        y = F.coalesce(F.try_divide("c1", F.col("c1") + 2 * F.col("c2")), F.lit(0.5))
        part = lambda i, rest: F.least(F.greatest(F.coalesce(i - (i + 1) * y * F.try_divide(f"c{i + 1}", f"c{i}"), F.lit(rest)), F.lit(0.05)), F.lit(i - 0.05))  # noqa: B023, E731
        discounts = c.select("lang", part(1, 0.5).alias("d1"), part(2, 1.0).alias("d2"), part(3, 1.5).alias("d3"))
        own = grams[k].select("lang", "gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k).alias("suffix"), "n")
        same = lambda a, b, *on: a.join(b, [a[x].eqNullSafe(b[x]) if x == "lang" else a[x] == b[x] for x in on])
        own = same(own, discounts, "lang").select(own["*"], F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("all"), (F.sum("d") / F.sum("n")).alias("leave"))
        joined = same(own, contexts, "lang", "context").select(own["*"], contexts["all"], contexts["leave"])
        lower = known.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
        joined = same(joined, lower, "lang", "suffix").select(joined["*"], lower["low"])
        p = (F.col("n") - F.col("d")) / F.col("all") + F.col("leave") * F.col("low")
        table = written(joined.select("lang", "gram", p.alias("p"), (F.log(p) - F.log("leave") - F.log("low")).alias("gain")), "weights")
        known = table.select("lang", "gram", "p")
        more = table.select("lang", "gram", "gain", F.lit(0.0).alias("leave"))
        more = more.unionByName(contexts.select("lang", F.col("context").alias("gram"), F.lit(0.0).alias("gain"), F.log("leave").alias("leave")))
        leaves = more if leaves is None else leaves.unionByName(more)
    # the empty context stands before every position, and so does the probability of any character
    leaves = leaves.unionByName(below.select("lang", "gram", F.log("p").alias("gain"), F.lit(0.0).alias("leave")))
    return leaves.groupBy("lang", "gram").agg(F.sum("gain").alias("gain"), F.sum("leave").alias("leave"))


class _Table:
    """Weights by key: the arrays of ``in_order`` as they come, and where the keys begin that share their leading bits."""

    def __init__(self, keys: np.ndarray, gain: np.ndarray, leave: np.ndarray):
        bits = max(8, len(keys).bit_length())
        self.keys, self.gain, self.leave, self.shift = keys, gain, leave, np.uint64(64 - bits)
        many = np.bincount((keys[:-1] >> self.shift).view(np.int64), minlength=1 << bits)
        self.begin = (np.cumsum(many) - many).astype(np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; unknown keys get the last slot, whose weights are zero."""
        slot = self.begin[keys >> self.shift]
        there = self.keys[slot]
        behind = np.flatnonzero(there < keys)
        while len(behind):
            at = slot[behind] + 1
            slot[behind] = at
            there[behind] = self.keys[at]
            behind = behind[there[behind] < keys[behind]]
        slot[there != keys] = len(self.keys) - 1
        return slot


def in_order(keys: np.ndarray, gain: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weights in the order of their keys; the largest key, without weight, ends them. Workers need no copy then."""
    order = np.argsort(keys)
    return tuple(np.append(x[order], x.dtype.type(end)) for x, end in ((keys, 0xFFFFFFFFFFFFFFFF), (gain, 0), (leave, 0)))


def _score_pass(docs: DataFrame, shard, order: int, first: bool) -> DataFrame:
    schema = docs.schema if not first else T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("positions", T.LongType())])
    shared, token, names = docs.sparkSession.sparkContext.broadcast(shard), uuid.uuid4().hex, docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = kept_by("quality_lm")
        if token not in tables:
            while len(tables) >= 2:
                del tables[next(iter(tables))]
            tables[token] = _Table(*shared.value)
        table = tables[token]
        for part, texts in byte_slices(batches, "text", SLICE):
            codes, begin = _codes(texts, order)
            seeds = np.array([_lang_seed(x) for x in part.column("lang").to_pylist()], dtype=np.uint64)
            sizes = np.diff(begin)
            total = np.zeros(len(codes) - order + 1, dtype=np.float64)
            ends = begin[1:] - 1 - (order - 1)  # a text's last position; nothing follows its context
            for k, key in enumerate(_keys(codes, np.repeat(seeds, sizes), order), 1):
                slot = table.slots(key)
                total += table.gain[slot]
                if k < order:
                    leave = table.leave[slot]
                    leave[ends] = 0
                    total += leave
            # before a text's first character stand edges; their contexts count as well
            sums = np.concatenate([[0.0], np.cumsum(total)])
            score = sums[ends + 1] - sums[begin[:-1]]
            score += self_context(table, seeds, order)
            if first:
                columns = [part.column(c) for c in names] + [pa.array(score), pa.array(sizes - order + 1)]
            else:
                old = part.column("score").to_numpy(zero_copy_only=False)
                columns = [part.column(c) if c != "score" else pa.array(old + score) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(giving_back(scan), schema)


def self_context(table: _Table, seeds: np.ndarray, order: int) -> np.ndarray:
    """The weights of the contexts of edges alone, which stand before a text's first character."""
    kinds, back = np.unique(seeds, return_inverse=True)
    out = np.zeros(len(kinds))
    for i, seed in enumerate(kinds):
        edges = np.full(order - 1, EDGE, dtype=np.uint64)
        for key in _keys(edges, np.full(order - 1, seed, dtype=np.uint64), order - 1):
            out[i] += table.leave[table.slots(key[-1:])][0]
    return out[back]


def score(docs: DataFrame, weights: DataFrame, order: int = ORDER, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``docs`` (``lang``, ``text`` and others) with ``score`` (sum of log-probabilities) and ``positions``.

    ``weights`` is read once to count it and once per shard: write it first.
    """
    spark = docs.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.zeros(b.num_rows, dtype=np.uint64)
            gram = b.column(1).to_pylist()
            lang = b.column(0).to_pylist()
            size = np.array([len(g) for g in gram])
            seeds = np.array([_lang_seed(x) for x in lang], dtype=np.uint64)
            for k in range(1, order + 1):
                rows = np.flatnonzero(size == k)
                if len(rows):
                    codes = np.frombuffer("".join(gram[i] for i in rows).encode("utf-32-le"), "<u4").astype(np.uint64)
                    *_, all_keys = _keys(codes, np.repeat(seeds[rows], k), k)
                    key[rows] = all_keys[::k]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(2).cast(pa.float32()), b.column(3).cast(pa.float32())], names=["key", "gain", "leave"])

    table = weights.where("gram <> ''").select("lang", "gram", "gain", "leave").mapInArrow(keyed, "key long, gain float, leave float")
    shards = max(1, math.ceil(1.1 * table.count() / shard_entries))
    out = docs.drop("score", "positions")
    for s in range(shards):
        part = table.where(F.pmod("key", F.lit(shards)) == s) if shards > 1 else table
        arrow = part.toArrow()
        arrays = tuple(arrow.column(i).to_numpy() for i in range(3))
        out = _score_pass(out, in_order(arrays[0].view(np.uint64), *arrays[1:]), order, s == 0)
        if s % SHARDS_PER_PASS == SHARDS_PER_PASS - 1 and s < shards - 1:
            out = written(out, "scored")
    each = weights.where("gram = ''").select(F.col("lang").alias("model_lang"), (F.col("gain") + F.col("leave")).alias("each"))
    out = out.join(each, out["lang"].eqNullSafe(each["model_lang"]) & each["each"].isNotNull(), "left").drop("model_lang")
    return out.withColumn("score", F.col("score") + F.col("positions") * F.col("each")).drop("each")


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents that all their labels call good and not toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.groupBy(F.col(doc_id).alias("trusted_id")).agg(F.min(good).alias("good")).where("good").select("trusted_id")


#: one trusted text in so many sets thresholds instead of counts
HELD_OUT = 5


def _held_out(text_hash):
    return F.pmod(text_hash, F.lit(HELD_OUT)) == 0


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``doc_id, text_hash, lang, held_out, positions, log_perplexity`` for every row of ``docs``."""
    ids = trusted_ids(labels)
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.where(~_held_out(F.xxhash64("text"))).join(ids, docs["doc_id"] == ids["trusted_id"], "left_semi")
    weights = written(estimate(count_grams(counted.select("lang", text.alias("text")), order), order), "model")
    rows = score(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", text.alias("text")), weights, order, shard_entries).drop("text")
    rows = rows.join(ids.withColumn("trusted", F.lit(True)), rows["doc_id"] == ids["trusted_id"], "left").drop("trusted_id")
    return rows.select("doc_id", "text_hash", "lang", F.coalesce(F.col("trusted") & _held_out(F.col("text_hash")), F.lit(False)).alias("held_out"), "positions", (-F.col("score") / F.col("positions")).alias("log_perplexity"))


#: quantile of the held-out documents' deviations, widened by ``SLACK``, that bounds what is kept
QUANTILE, SLACK, FEW = 0.995, 1.5, 200


def judge(scored: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """``scored`` (read twice: write it first) with ``deviation``, its bound ``most``, and ``kept``."""
    held = scored.where("held_out")
    mean = held.groupBy(F.col("lang").alias("model_lang")).agg((F.sum(F.col("log_perplexity") * F.col("positions")) / F.sum("positions")).alias("mean"))
    deviate = lambda df: df.join(mean, df["lang"].eqNullSafe(mean["model_lang"]), "left").withColumn("deviation", (F.col("log_perplexity") - F.col("mean")) * F.sqrt("positions")).drop("model_lang", "mean")
    held = deviate(held)
    end = F.percentile_approx("deviation", quantile, 10_000)
    own = held.groupBy(F.col("lang").alias("bound_lang")).agg(end.alias("end"), F.count("*").alias("many"))
    pooled = held.select(end.alias("pooled")).scalar()
    bound = F.when(F.col("many") < FEW, F.greatest("end", pooled)).otherwise(F.col("end")) * slack
    own = own.select("bound_lang", bound.alias("most"))
    out = deviate(scored)
    out = out.join(own, out["lang"].eqNullSafe(own["bound_lang"]), "left").drop("bound_lang")
    return out.withColumn("kept", F.coalesce(F.col("deviation") <= F.col("most"), F.lit(True)))


def quality_scores(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """``doc_id, text_hash, lang, positions, perplexity, deviation, most, kept`` for every row of ``docs``."""
    found = judge(written(perplexities(docs, labels, order), "perplexities"), quantile, slack)
    return found.select("doc_id", "text_hash", "lang", "positions", F.exp("log_perplexity").alias("perplexity"), "deviation", "most", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    gone = quality_scores(docs, labels, **how).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), F.col("lang").alias("gone_lang")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]) & docs["lang"].eqNullSafe(gone["gone_lang"])
    return docs.join(gone, same, "left_anti")
