"""Lexical search, periodic runs and toxicity against plain versions, planted cases and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stepframe.llm import lexical_search, periodic_runs, toxicity
from stepframe.llm.queries import QUERIES, with_planted_runs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_search(items, docs, k=20):
    bags = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, length = len(bags), sum(size for _, _, size in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        hits = []
        for d, b, size in bags:
            m = 75 + 25 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in TERM.findall(lower(text)) if t in b)
            if score > 0:
                hits.append((-score, d is not None, d, d))
        out += [(item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def plain_runs(words, least=12):
    out = []
    for q in range(1, len(words) // 2 + 1):
        same, x = [a == b for a, b in zip(words, words[q:])], 0
        while x < len(same):
            y = x
            while y < len(same) and same[y]:
                y += 1
            part = words[x : y + q]
            if y > x and len(part) >= max(least, 2 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((x, len(part), q))
            x = max(y, x + 1)
    return sorted(out)


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark", "labels")}


def test_op11(spark, tables):
    docs = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in QUERIES["op11_lexical_search"](spark, DATA).collect()]
    assert sorted(got, key=str) == plain_search(items, docs) and got


@pytest.mark.parametrize("postings, item_bytes, k", [(400_000, 1 << 20, 20), (30, 1 << 20, 3), (7, 60, 5)])
def test_search_ties_blocks_and_repeats(spark, postings, item_bytes, k):
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choice("ab cd Ef gh ij kl mn op qr".split()) for _ in range(n))
    docs = [(i, text(draw.randint(0, 12))) for i in range(120)]
    docs += [(i, "ab cd ab") for i in range(500, 560)] + [(7, "ab cd ab"), (7, "ab cd ab"), (None, "ab cd ab"), (None, None), (900, ""), (901, "...")]
    draw.shuffle(docs)
    items = [(1, "AB cd"), (1, "AB cd"), (1, "ef gh ij kl"), (2, "ab ab ab qr"), (3, ""), (4, None), (5, "zz"), (None, "mn op"), (6, text(40))]
    found = lexical_search.search(
        spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("own")),
        spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("own"), "terms": F.lit(1)}).repartition(3),
        k=k,
        postings=postings,
        item_bytes=item_bytes,
    )
    want = plain_search([(i, t) for i, t in items if t], docs, k)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_search_empty_tables(spark, tables):
    none = tables["documents"].limit(0)
    assert lexical_search.search(tables["benchmark"], none).count() == 0
    assert lexical_search.search(tables["benchmark"].limit(0), tables["documents"]).count() == 0


def test_range_maxima():
    draw = np.random.default_rng(3)
    term = np.sort(draw.integers(0, 4, 60))
    doc = np.concatenate([np.sort(draw.choice(80, int((term == t).sum()), replace=False)) for t in range(4)])
    value = draw.integers(1, 9, 60)
    block = lexical_search.Block(term, doc, value, 80)
    for t in range(4):
        own = np.flatnonzero(term == t)
        for lo in own:
            for hi in range(lo + 1, own[-1] + 2):
                assert block.maxima(np.array([lo]), np.array([hi]))[0] == lo + int(np.argmax(value[lo:hi]))
    assert block.maxima(np.array([5]), np.array([5]))[0] == -1


def test_squared_differences_are_exact():
    draw = np.random.default_rng(1)
    blocks, windows = draw.integers(0, 5_000_000, (3, 8)), draw.integers(0, 5_000_000, (3, 23))
    windows[1, 4:12] = blocks[1]
    for prime, generator, _ in periodic_runs.PRIMES:
        got = periodic_runs.squared_differences(blocks, windows, prime, generator)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y[at : at + 8])) % prime for at in range(16)] for x, y in zip(blocks, windows)]
        assert got.tolist() == want
    assert np.argwhere(periodic_runs.occurrences(blocks, windows)).tolist() == [[1, 4]]
    assert not periodic_runs.occurrences(blocks[:1], windows[:1]).any()


def test_runs_of_random_words():
    draw = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(draw.randint(1, 5)):
            few, n = draw.choice([1, 2, 3, 30]), draw.randint(0, 140)
            words = [draw.randrange(few) for _ in range(n)]
            if n and draw.random() < 0.6:
                a = draw.randrange(n)
                p = 1 + draw.randrange((n - a) // 2 + 1)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        got = periodic_runs.periodic_runs(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]))
        assert got == [plain_runs(t) for t in texts]


def test_op12(spark, tables):
    want = {}
    for r in tables["documents"].collect():
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if n < 1500 else None
        if runs is None:  # the plain version is quadratic
            continue
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        top = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
        want[r.doc_id] = (len(runs), *top, digest, hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    assert {d: got[d] for d in want} == want and len(got) >= len(want) and sum(v[0] for v in want.values())


def test_runs_of_odd_rows(spark):
    texts = ["la " * 40, "a b " * 30 + "c", None, "", " \n\t", "x", "é ü ß " * 5, "one two three", "la " * 40, "w " * 60_000, "no break " * 12]
    df = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"runs": F.lit("own"), "length": F.lit(3)})
    got = [(r.text, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.length) for r in periodic_runs.find_runs(df).collect()]
    assert len(got) == len(texts)
    for text, n, runs, collapsed, own in got:
        words = WORD.findall(text or "")
        want = plain_runs(words) if n < 1000 else [(0, 60_000, 1)]
        assert (n, runs, collapsed, own) == (len(words), want, plain_collapsed(words, want), 3)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    ids = spark.createDataFrame([(None, "a b c d"), (0, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in with_planted_runs(ids).collect()] == ["a b c d", None, ""]


INSULTS = ["numbskull", "blockhead", "scoundrel", "dimwitted", "ignoramus"]


def toxic_corpus(n, seed):
    draw = random.Random(seed)
    plain = ["".join(draw.choice("aeioulmnrst") for _ in range(draw.randint(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 200))]
        if i % 3 == 0:
            for _ in range(2):
                words[draw.randrange(len(words))] = draw.choice(INSULTS)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_learns_from_words_and_misspellings(spark):
    rows = toxic_corpus(600, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:400]], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    late = rows[400:]
    assert np.mean([(found[d] >= 0.5) == t for d, _, t in late]) > 0.95
    table, bias = model.subword_scores()
    wrong = ["numbskul", "blokhead", "scoundrell", "dimwited", "ignoramuss"]  # never seen
    clean = rows[401][1].split()[:5]
    bad, good = (toxicity.text_scores([w.encode() for w in ws], table, bias) for ws in (wrong, clean))
    assert bad.min() > good.max() and (bad > 0).mean() >= 0.8


def test_subwords_and_stretches():
    texts = [b"", b"Ab, cd! efghij", b"   ", "é".encode(), b"one two three four five six seven"]
    words = toxicity.split_words(texts)
    assert [bytes(words.data[a:b]) for a, b in zip(words.first, words.end)] == [b"ab", b"cd", b"efghij", "é".encode(), *b"one two three four five six seven".split()]
    assert words.text.tolist() == [1, 1, 1, 3, 4, 4, 4, 4, 4, 4, 4]
    many = Counter(w for word, _ in toxicity.subwords(words) for w in word.tolist())
    want = lambda n: sum(max(0, n + 2 - k + 1) for k in toxicity.GRAMS) + 1
    assert many == {i: want(b - a) for i, (a, b) in enumerate(zip(words.first, words.end))}
    number, text, size = toxicity.stretches(words)
    assert text.tolist() == [1, 3, 4, 4, 4] and size.tolist() == [3, 1, 3, 3, 1] and number[-1] == 4
    assert toxicity.text_scores([b"", b"."], np.ones(1 << toxicity.BITS), -2.0).tolist() == [-2.0, -2.0]


def test_toxicity_odd_rows(spark):
    rows = [(1, "a fine text", "x"), (None, None, "x"), (2, "", "x"), (3, None, "x"), (1, "a fine text", "x"), (4, "x " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("__label", F.lit(1))
    marks = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (77, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    scored = toxicity.score_texts(df, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score_texts(df.limit(0), model).count() == 0
    assert toxicity.fit(df, marks.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score_texts(df, None).collect()} == {0.0}


def test_training_sample_is_bounded(spark):
    rows = toxic_corpus(90, 2)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000 + i, rows[0][1]) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1000 + i, 1) for i in range(50)], "doc_id long, toxic int")
    texts, marks = toxicity.training_sample(docs, labels, per_class=12, sample_bytes=9_000)
    assert len(set(texts)) == len(texts) and sum(map(len, texts)) <= 9_000 and 0 < marks.sum() <= 12 and (1 - marks).sum() <= 12


def test_op13(spark, tables):
    got = QUERIES["op13_toxicity"](spark, DATA).collect()
    assert {r.doc_id: r.held_out for r in got} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in tables["documents"].collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op13_held_out_accuracy(spark):
    base = DATA.replace("sf0.001", "sf0.1")
    got = QUERIES["op13_toxicity"](spark, base).where("held_out").join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted == r.toxic == 1 for r in got)
    assert hit >= 0.75 * sum(r.toxic for r in got) and hit >= 0.75 * sum(r.predicted for r in got)
