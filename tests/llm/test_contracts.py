"""The registered queries against plain versions, over the smallest tables, and their operators on odd rows."""

import math
import random
import re
import textwrap
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from stepframe.llm import chat, common, decision_list, decontaminate, licenses, packing, pii, quality_lm, simhash, suffix_dedup, url_rules
from stepframe.llm.components import components
from stepframe.llm.queries import QUERIES, tokenizer_path

ODD = [
    (1, "plain words of a short text", "en"),
    (1, "plain words of a short text", "en"),
    (None, None, None),
    (2, None, "en"),
    (3, "", "en"),
    (None, "a text without an id, mail me@some.example.org or +1 (234) 567-8901", "fr"),
    (4, "   \n\t  ", None),
    (5, "é😀 ü ß\n" * 400, "de"),
    (6, "x" * 50_000, "en"),
    (7, "1 2 3 " * 9000, "en"),
    (8, "plain words of a short text", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns named like those that operators use."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    names = ["source", "fp", "base", "spans", "terms", "text_hash", "found", "n_words", "scan", "kept_hash", "kept_row", "stats", "score", "positions"]
    return rows.withColumns({n: F.lit(f"own {n}") for n in names}).withColumn("n_chars", F.length("text").cast("long"))


def rows_of(name, spark, *columns):
    return [tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect()]


def test_op1(spark, docs):
    ids = list(docs)
    want = dict(zip(ids, brute.op1([docs[i] for i in ids])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_suffix_dedup"](spark, DATA).collect()}
    assert got == want and sum(x[1] for x in want.values())


@pytest.mark.parametrize("group_rows", [8192, 4])
def test_op1_small_and_split_groups(spark, group_rows):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abcd") for _ in range(n))
    cores = [text(n) for n in (500, 420, 900, 405)]
    texts = [text(draw.randint(0, 300)) + draw.choice(cores)[draw.randint(0, 30) :] + text(draw.randint(0, 200)) for _ in range(60)]
    texts += ["a" * 2000, "a" * 401, "a" * 400, "ab" * 700, "", None, texts[0], texts[0], "é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, group_rows=group_rows).collect()}
    assert got == dict(enumerate(brute.op1(texts)))


def test_op1_odd_rows(spark, odd):
    got = sorted(tuple(r)[2:] for r in suffix_dedup.remove_repeats(odd).collect())
    assert got == sorted(brute.op1([t for _, t, _ in ODD]))
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def plain_kneser_ney(texts, n):
    counts = {n: Counter()}
    for t in texts:
        s = "\n" * (n - 1) + t + "\n"
        counts[n].update(s[i : i + n] for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        many = Counter(c.values())
        y = many[1] / (many[1] + 2 * many[2]) if many[1] + 2 * many[2] else 0.5
        discount[k] = [min(max(i - (i + 1) * y * many[i + 1] / many[i] if many[i] else rest, 0.05), i - 0.05) for i, rest in ((1, 0.5), (2, 1.0), (3, 1.5))]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        next_ = [c for g, c in counts[k].items() if g[:-1] == gram[:-1]]
        if not next_:
            return p(gram[1:])
        d = lambda c: discount[k][min(c, 3) - 1]
        c = counts[k][gram]
        return ((c - d(c) if c else 0) + sum(map(d, next_)) * p(gram[1:])) / sum(next_)

    return p


@pytest.mark.parametrize("entries", [10_000, 20])
def test_op2_model(spark, entries):
    rows = [("x", "abracadabra abra cad"), ("x", "abab abab ra"), ("x", ""), ("y", "zzz yyy zyz"), (None, "no language")]
    df = spark.createDataFrame(rows, "lang string, text string")
    weights = quality_lm.written(quality_lm.estimate(quality_lm.count_grams(df, 3), 3), "test")
    other = spark.createDataFrame([*rows, ("x", "new text"), ("z", "no model")], "lang string, text string")
    for r in quality_lm.score(other, weights, 3, entries).collect():
        own = [t for lang, t in rows if lang == r.lang]
        assert r.positions == len(r.text) + 1
        if not own:
            assert r.score is None
            continue
        p, s = plain_kneser_ney(own, 3), "\n\n" + r.text + "\n"
        assert r.score == pytest.approx(sum(math.log(p(s[i : i + 3])) for i in range(len(s) - 2)), rel=1e-5)


def test_op2_held_out(spark):
    """Clean documents stay, most of those labelled as bad go."""
    base = DATA.replace("0.001", "0.01")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    found = QUERIES["op2_quality_perplexity"](spark, base).collect()
    share = lambda q: (lambda k: sum(k) / len(k))([r.kept for r in found if labels.get(r.doc_id, (None,))[0] == q])
    assert len(found) == 1000 and share(1) > 0.97 and share(0) < 0.4


def test_op2_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (5, 1, 0), (6, 1, None), (None, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    found = quality_lm.quality_scores(odd, labels)
    assert found.count() == len(ODD)
    assert quality_lm.keep_good(odd, labels).columns == odd.columns
    assert quality_lm.quality_scores(odd.limit(0), labels).count() == 0
    assert quality_lm.keep_good(odd, labels.limit(0)).count() == len(ODD)


def test_op3(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for page, host, path, rule, verdict in rows_of("op3_url_rules", spark, "page_id", "host", "path", "rule", "verdict"):
        want = brute.op3(urls[page])
        assert (host, path, rule) == want[:3] and verdict == (want[3] or verdict)


def test_op3_blocks_bad_hosts_only(spark):
    """Of the pages that the list leaves open, those whose host has a word of the lexicon are blocked, no others."""
    base = DATA.replace("0.001", "0.01")
    found = [r for r in QUERIES["op3_url_rules"](spark, base).collect() if r.rule is None]
    bad = [not set(re.split("[.-]", re.sub("[0-9]+", "#", r.host))).isdisjoint(url_rules.LEXICON) for r in found]
    assert 0 < sum(bad) < len(found) / 4
    assert [r.verdict == "block" for r in found] == bad


def test_op3_learns_combinations(spark):
    """Rules from labelled urls hold on urls that are not labelled; a token on both sides decides nothing."""
    hosts = ["alpha", "beta", "gamma", "delta"]
    say = lambda h, p: "block" if h in ("alpha", "beta") and p == "win" else "allow"
    urls = [(f"http://{h}-site.example.net/{p}/{k}x", say(h, p)) for h in hosts for p in ("win", "news") for k in "abcdefghijklmnopqrstuvwxyz"]
    listed_only = [(f"http://a.com/de/{k}", "block") for k in range(50)]
    labelled = spark.createDataFrame(urls + listed_only, "url string, label string")
    pages = spark.createDataFrame([(i, f"https://m.{h}-site.example.com/en/{p}/new") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("win", "news"))], "page_id long, url string")
    got = [r.verdict for r in url_rules.filter_urls(pages, labelled).orderBy("page_id").collect()]
    assert got == [say(h, p) for h in hosts for p in ("win", "news")]


def test_op3_odd_rows(spark):
    urls = [None, "", "no url", "http://", "HTTP://A.Example.ORG/es/x", "x://org", "x://notorg/", "https://www.example.org/en/12?q=/de/", "http://Ünicode.COM/de/#f", "a://b.com/fr/?x=://c.org/", "http://casino.example.net/?A1=2&b"]
    pages = spark.createDataFrame([(i % 7, u, "h") for i, u in enumerate(urls * 2)], "page_id long, url string, mined string")
    got = url_rules.filter_urls(pages).collect()
    assert sorted((r.host, r.path, r.rule or "") for r in got) == sorted((h, p, r or "") for h, p, r, _ in map(brute.op3, urls * 2))
    assert url_rules.filter_urls(pages.limit(0)).count() == 0


def test_op3_mining(spark):
    rows = [(["h:a", "p:x"], "block")] * 40 + [(["h:a"], "allow")] * 40 + [(["p:x"], "allow")] * 40 + [(["h:bad", "p:y"], "block")] * 40
    found = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.01, 0.95).collect()
    # the pair is needed in one case; in the other one token is enough and the pair says no more
    assert sorted(r.tokens for r in found) == [["h:a", "p:x"], ["h:bad"], ["p:y"]]
    sets = spark.createDataFrame([(["h:a", "p:x", "q:z"],), (["h:a", "q:z"],), (["p:y"],)], "tokens array<string>")
    fired = {tuple(r.tokens): r.mined for r in url_rules.fired(sets, url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.01, 0.95)).collect()}
    assert fired == {("h:a", "p:x", "q:z"): "h:a p:x", ("p:y",): "p:y"}


def test_op4(spark, docs):
    for doc, *got in rows_of("op4_personal_data", spark, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"):
        assert tuple(got) == brute.op4(docs[doc])


def test_op4_patterns(spark):
    draw = random.Random(3)
    letters = "aZ9.@-_+ ()1234567890é."
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 300))) for _ in range(400)]
    texts += ["5105 1051 0510 5100 4111-1111-1111-1111 a@b.c_x@d.e 1.2.3.4.5.6.7.8 0255.1.1.256", "1" * 30_000, "a" * 30_000, "+1" + "(" * 20_000, "1." * 20_000, "", None, "😀 x@y.zz é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("doc_id", F.sha2(pii.span_text(pii.base_spans(F.coalesce("text", F.lit("")))), 256).alias("got")).collect():
        assert r.got == brute.op4(texts[r.doc_id])[4], texts[r.doc_id]


def test_op4_terms(spark):
    """A word that stands by one address in several texts, and nowhere else, reveals it; a common word does not."""
    rows = [(i, f"number {i} write to Quixby here ann@mail.example.org today and number {i} again") for i in range(4)]
    rows += [(10 + i, f"number {i} today here is text without any address") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(df, contexts=3).collect()}
    for i in range(4):
        words = {rows[i][1][s.start : s.end] for s in found[i].spans if pii.KINDS[s.kind] == "term"}
        assert "Quixby" in words and not words & {"number", "today", "here"}
    assert not any(found[10 + i].spans for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(df, contexts=3).collect()}
    assert "[TERM] here [EMAIL] today" in clean[0] and clean[10] == rows[4][1]
    assert "@" not in pii.sanitise(df, generalise=False).where("doc_id = 0").head().text


def test_op4_odd_rows(spark, odd):
    assert pii.find_pii(odd).count() == len(ODD)
    clean = pii.sanitise(odd, chars="n_chars")
    assert clean.columns == odd.columns
    changed = {r.text for r in clean.select("text").collect()} - {t for _, t, _ in ODD}
    assert changed == {"a text without an id, mail [EMAIL] or [PHONE]"}
    assert {r.spans for r in clean.select("spans").collect()} == {"own spans"}
    assert pii.sanitise(odd.limit(0)).count() == 0


def test_op5(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    ids = list(docs)
    want = dict(zip(ids, brute.op5([docs[i] for i in ids], items)))
    got = {r[0]: r[1:] for r in rows_of("op5_benchmark_hits", spark, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    assert got == want and any(x[4] for x in want.values())


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_op5_windows(spark, shard_bytes):
    draw = random.Random(7)
    words = lambda n: " ".join(draw.choice(["a", "B", "c", "dé", "E9"]) for _ in range(n))
    items = [(i, words(draw.choice([1, 3, 5, 13, 14, 20, 30]))) for i in range(12)] + [(1, "a b"), (None, words(15)), (50, None), (51, "..."), (2, "unseen")]
    texts = [words(draw.randint(0, 80)) + "; " + (draw.choice(items)[1] or "") + words(draw.randint(0, 20)) for _ in range(60)] + [None, "", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.benchmark_hits(df, bench, shard_bytes=shard_bytes)
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.hit_items), brute.sha(",".join(r.hit_items)), r.c) for r in found.withColumn("c", decontaminate.contaminated()).collect()}
    assert got == dict(enumerate(brute.op5(texts, items)))


def test_op5_cut_and_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, "so: One, two; three! ends"), (2, None)], "doc_id long, text string")
    assert [r.text for r in decontaminate.cut_spans(decontaminate.benchmark_hits(df, bench), 3).orderBy("doc_id").collect()] == ["so: ! ends", None]
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert {r[0] for r in kept.select("found").collect()} == {"own found"}
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == len(ODD)
    assert decontaminate.decontaminate(odd.limit(0), bench).count() == 0


def test_decontamination_cuts_what_stays(spark):
    """A long text with a verbatim item under the limit stays without the item; other texts stay as they are."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy(F.length("text").desc()).head().text
    many = len(item.split())
    long = " ".join(f"own{i}" for i in range(many * 30))
    rows = [(1, f"{long} <{item}>! end"), (2, f"short {item}"), (3, "Nothing  here."), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.decontamination(spark, df, DATA).collect()}
    assert set(got) == {1, 3, 4} and got[3] == ("Nothing  here.", 14) and got[4] == (None, None)
    left, chars = got[1]
    assert left.startswith(f"{long} <") and left.endswith("! end") and item[:40] not in left and chars == len(left) < len(rows[0][1])
    hits = decontaminate.benchmark_hits(spark.createDataFrame([(1, left)], "doc_id long, text string"), spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert hits.head().n_hit == 0


def test_op6(spark, docs):
    want = brute.op6(list(docs.items()))
    assert {r[0]: r[1:] for r in rows_of("op6_simhash_components", spark, "doc_id", "fingerprint", "component_id")} == want


@pytest.mark.parametrize("group_rows", [4096, 10])
def test_op6_links(spark, group_rows):
    draw = random.Random(1)
    prints = set()
    for _ in range(12):
        middle = draw.getrandbits(64)
        for _ in range(50):
            x = middle
            for _ in range(draw.randint(0, 6)):
                x ^= 1 << draw.randrange(64)
            prints.add(x - (1 << 64) if x >> 63 else x)
    order = sorted(prints)
    top = {x: x for x in order}
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and top[a] != top[b]:
                low, high = sorted((top[a], top[b]))
                top = {x: low if t == high else t for x, t in top.items()}
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in order], "fp long"), 3, group_rows)
    got = {r.node: r.label for r in components(links, "a", "b").collect()}
    assert {x: got.get(x, x) for x in order} == top


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}
    assert components(links.limit(0), "a", "b").count() == 0


def test_op6_odd_rows(spark, odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    empty = {r.component_id for r in found if r.fp == 0}
    assert len(empty) == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(t or "" for t in {r.text for r in kept.collect()}).count("plain words of a short text") == 1
    assert kept.count() == len({r.group for r in found})
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_similar_texts(spark):
    """The pipeline's stage links by five-word shingles, 0.8 or more, which is many more than three differing bits."""
    draw = random.Random(11)
    rows, want = [], set()
    for k in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(150)]
        near, far = list(words), list(words)
        near[20] = near[90] = "other"  # ten of 146 shingles differ: 136 / 156
        for at in range(10, 140, 30):
            far[at] = "other"  # 121 / 171
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(near).upper()), (10 * k + 2, " ".join(far)), (10 * k + 3, " ".join(words))]
        want |= {10 * k, 10 * k + 2}
    rows += [(1000, ""), (1001, None), (1002, "one two"), (1003, "one  two"), (1004, "one three"), (None, "of no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, DATA)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == want | {1000, 1002, 1004, None}
    split = simhash.similar_texts(df, group_rows=2).select("group").distinct().count()
    assert split == len(want) + 4


def test_chance_meetings(spark):
    """Nodes that share an anchor but cannot be similar end there; those that can stay, in batches of any size."""
    draw, rows = random.Random(5), []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for k in range(40):  # all share the first block of their third print, and nothing else
        prints = [signed(draw.getrandbits(64)) for _ in range(8)]
        prints[2] = signed(draw.getrandbits(64) >> simhash.BLOCK << simhash.BLOCK | (1 << simhash.BLOCK) - 1)
        rows.append((k, 100, prints))
        if k % 20 == 0:  # 70 shingles of 90 or 100 cannot be 0.8
            rows += [(1000 + k, 90, [prints[0] ^ 1 << 40, *prints[1:]]), (2000 + k, 70, prints)]
    far = lambda a, b: sum(((a[2][i] ^ b[2][i]) & (1 << 64) - 1).bit_count() for i in (0, 1))
    near = {a[0] for a in rows for b in rows if a[0] != b[0] and far(a, b) <= simhash.FAR and 5 * min(a[1], b[1]) >= 4 * max(a[1], b[1])}
    assert {0, 20, 1000, 1020} <= near and len(near) < 10 and len(rows) < simhash.CHANCE_ROWS
    prints = spark.createDataFrame(rows, "node long, n int, prints array<long>")
    want = None
    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = simhash._shared_anchors(prints).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r.node for r in got} == near
        assert len(got) == len({(r.anchor, r.node) for r in got})
        want = want or sorted(map(tuple, got))
        assert sorted(map(tuple, got)) == want
    copies = [(5000 + k, 100, rows[0][2]) for k in range(simhash.CHANCE_ROWS + 9)]
    many = simhash._shared_anchors(spark.createDataFrame(copies, "node long, n int, prints array<long>"))
    assert many.select("node").distinct().count() == len(copies) and {r["count"] for r in many.collect()} == {len(copies)}
    assert [simhash._part_bits(x) for x in (0, 200_000, 12_000_000, 10**12)] == [4, 4, 7, 10]


def test_similar_texts_plain(spark, docs):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {d: shingles(t) for d, t in docs.items()}
    top = {d: d for d in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            x, y = sets[a], sets[b]
            if a < b and 5 * len(x & y) >= 4 * len(x | y) and top[a] != top[b]:
                low, high = sorted((top[a], top[b]))
                top = {d: low if t == high else t for d, t in top.items()}
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert {r.doc_id for r in kept.collect()} == set(top.values())


def test_op7(spark, docs):
    for doc, *got in rows_of("op7_quality_rules", spark, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
        assert tuple(got) == brute.op7(docs[doc])


def test_op7_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = decision_list.quality_rules(odd, labels).collect()
    want = [brute.op7(t) for _, t, _ in ODD]
    assert sorted(tuple(r)[1:7] for r in got) == sorted(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert decision_list.quality_rules(odd.limit(0), labels.limit(0)).count() == 0


def test_op7_learns_ordered_rules(spark):
    draw = random.Random(4)
    rows = []
    for _ in range(3000):
        a, b, c = draw.random(), draw.random(), draw.random()
        rows.append((a, b, c, int(a > 0.8 and b > 0.5 or c < 0.1)))
    df = spark.createDataFrame(rows[:2000], "a double, b double, c double, bad int")
    rules = decision_list.learn(df, ["a", "b", "c"])
    test = spark.createDataFrame(rows[2000:], "a double, b double, c double, bad int")
    rule = decision_list.decide(rules, {x: F.col(x) for x in "abc"})
    wrong = test.where((rule.isNotNull()).cast("int") != F.col("bad")).count()
    assert wrong < 60 and len(rules) >= 2
    assert decision_list.learn(df.where("bad = 0"), ["a", "b", "c"]) == []


def check_packing(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op8(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = QUERIES["op8_best_fit_packing"](spark, DATA).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {d: sorted(x) for d, x in got.items()} == {d: brute.op8_pieces(tokenizer, t) for d, t in docs.items()}
    assert check_packing(rows) <= 1.02 * math.ceil(sum(r.length for r in rows) / 4096) + 1


def test_op8_rounds_equal_best_fit_decreasing():
    draw = random.Random(2)
    for _ in range(60):
        capacity = draw.choice([7, 20, 64])
        sizes = [draw.randint(1, capacity) for _ in range(draw.randint(0, 120))]
        gaps = []
        for s in sorted(sizes, reverse=True):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - s)
            else:
                gaps.append(capacity - s)
        runs = packing.best_fit_runs(Counter(sizes), capacity)
        filled, placed = {}, Counter()
        for length, first, last, sequence, offset, each in runs:
            for rank in range(first, last + 1):
                at, k = divmod(rank - first, each)
                filled.setdefault(sequence + at, []).append((offset + k * length, length))
                placed[length] += 1
        assert placed == Counter(sizes) and len(filled) == len(gaps)
        for places in filled.values():
            assert sum(x for _, x in places) <= capacity
            assert [o for o, _ in sorted(places)] == [sum(x for _, x in sorted(places)[:i]) for i in range(len(places))]


def test_op8_words(spark):
    draw = random.Random(2)
    letters = "aBcÉéΣσİ'sdt.,!?;:  ́² 9½\n\t-_%<|endoftext|>ßǅ\x1c\x85中"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)] + ["x <|endoftext|>. <|ENDOFTEXT|>"]
    encoder = packing.encoder(tokenizer_path())
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [3, 1000])
def test_op8_table_of_words(spark, monkeypatch, remembered):
    """Words are remembered in arrays as whole words: long ones, zero bytes and a full table change nothing."""
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    monkeypatch.setattr(packing, "REMEMBERED_BASES", remembered)
    encoder = packing.WordEncoder(tokenizer_path())
    text = "ab ab\0 ab\0c \0 abcdefghijklmnop abcdefghijklmnopq abcdefghijklmnopr Abcdefgh abcdefgh. abcdefgh\u00a0i é" + " word" * 50
    for _ in range(2):
        for t, ids in zip([text, "", " ", text[::-1]], encoder.encode([x.encode() for x in [text, "", " ", text[::-1]]])):
            assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert encoder.encode([]) == [] and 0 < encoder.known.many <= remembered
    assert sum(x.nbytes for x in vars(packing._Words(1_000_000)).values() if hasattr(x, "nbytes")) < 64 << 20


def test_op8_odd_rows(spark, odd):
    rows = packing.pack_documents(odd, tokenizer_path()).collect()
    check_packing(rows)
    assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert packing.pack_documents(odd.limit(0), tokenizer_path()).count() == 0
    whole = packing.pack_documents(odd, tokenizer_path(), with_ids=True).where("doc_id = 3").head()
    assert bytes(whole.ids) == (1).to_bytes(4, "little")


def test_op9(spark):
    said = r"\### Assistant: </turn> ok"
    turns = {-7: [("user", said), ("assistant", said)]}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r[0]: r[1:] for r in rows_of("op9_chat_format", spark, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")}
    assert got == {c: brute.op9(t) for c, t in turns.items()}


def test_op9_odd_rows(spark):
    odd_text = ["\\", "<", "\\l", "\\\\l<", "</turn>\n", "<turn user\n", "", None, "\\n\n", "é😀<\\<", "a" * 10_000]
    turns = {c: [(draw, odd_text[(c * 5 + i) % len(odd_text)]) for i, draw in enumerate(["system", "user", "assistant", None, "us\ner<\\"][: c % 6])] for c in range(1, 40)}
    rows = [(c, i, r, t, "x") for c, ts in turns.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digest(chat.format_chats(df)).collect()}
    assert got == {c: brute.op9(t) for c, t in turns.items() if t}
    valid = {r.conv_id: (r.valid, r.wrong_turn) for r in chat.format_chats(df).collect()}
    assert valid[3] == (True, None) and valid[2] == (False, None) and valid[5] == (False, 3)
    again = spark.createDataFrame([(None, None, "user", "b"), (None, None, "user", "a"), (None, None, "user", "a")], "conv_id long, turn int, role string, text string")
    assert chat.format_chats(again).head().formatted == "<turn user\na</turn>\n<turn user\na</turn>\n<turn user\nb</turn>\n"
    assert chat.format_chats(again.limit(0)).count() == 0


MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def test_op10(spark, docs):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Released under the MIT License.": "MIT"}
    for doc, found in rows_of("op10_license_scan", spark, "doc_id", "licenses"):
        assert set(filter(None, found.split(","))) == {name for line, name in lines.items() if line in docs[doc]}


def test_op10_rules(spark, odd):
    texts = ["MIT License\n\n" + MIT, MIT, "no. The MIT License. Copyright 2020 X. All rights reserved.", "licensed under CC BY 4.0! And: released into the public\ndomain.", "a licence to print money", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ([x.license for x in r.licenses], r.open_ids) for r in licenses.scan_licenses(df).collect()}
    assert got == {0: (["MIT"], []), 1: (["MIT"], ["Copyright"]), 2: (["MIT", "Proprietary"], []), 3: (["CC-BY-4.0", "CC0-1.0"], []), 4: ([], []), 5: ([], []), 6: ([], [])}
    found = licenses.scan_licenses(odd)
    assert found.count() == len(ODD) and found.select("scan").head()[0] == "own scan"
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
GPL2 = GPL3.replace("free software: you", "free software; you").replace("Foundation, either version 3", "Foundation; either version 2").split("\n\nYou should")[0]
LGPL = GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1")
LIBRARY = LGPL.replace("Lesser", "Library").replace("version 2.1", "version 2")
AGPL = GPL3.replace("GNU General", "GNU Affero General").split("\n\nYou should")[0]
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright (c) 2020, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
NOTICES = {
    "gpl 2": (GPL2, ["GPL-2.0-or-later"], []),
    "gpl 2 only": (GPL2.replace("either version 2 of the License, or\n(at your option) any later version", "version 2 of the License"), ["GPL-2.0-only"], []),
    "gpl 2 kernel": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2.0-only"], []),
    "lgpl": (LGPL, ["LGPL-2.1-or-later"], []),
    "library gpl": (LIBRARY, ["LGPL-2.0-or-later"], []),
    "lgpl 3": (LGPL.replace("version 2.1", "version 3"), ["LGPL-3.0-or-later"], []),
    "agpl": (AGPL, ["AGPL-3.0-or-later"], []),
    "mpl": (MPL, ["MPL-2.0"], []),
    "isc": (ISC, ["ISC"], ["Copyright"]),
    "bsd 2 clauses": (BSD2, ["BSD-2-Clause"], []),
    "bsd 3 clauses": (BSD3, ["BSD-3-Clause"], []),
    "apache": (APACHE, ["Apache-2.0"], ["Copyright"]),
    "gpl": (GPL3, ["GPL-3.0-or-later"], []),
    "gpl first": (GPL3.split("\n\n")[0], ["GPL-3.0-or-later"], []),
    "mit": ("MIT License\n\n" + MIT, ["MIT"], []),
    "mit grant": (MIT.split("\n\n", 1)[1], ["MIT"], []),
    "bsd 3": ("Licensed under the 3-Clause BSD License.\n\n" + BSD, ["BSD-3-Clause"], []),
    "bsd": (BSD, ["BSD"], []),
    "bsd line": ("Released under the BSD license.", ["BSD"], []),
    "apache line": ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"], []),
    "gpl line": ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"], []),
    "nc": ("This work is licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], []),
    "sa": ("This work is licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"], []),
    "by": ("This work is licensed under CC BY 4.0.", ["CC-BY-4.0"], []),
    "cc0": ("This is free and unencumbered software released into the public domain.", ["CC0-1.0"], []),
    "spdx": ("SPDX-License-Identifier: MIT", ["SPDX"], []),
    "all": ("Copyright (c) 2020 Some Body.\nAll rights reserved.", ["Proprietary"], []),
    "no whole sentence": ("We like the MIT license. It is not GPL; see below | all rights reserved by law.", [], []),
}


def test_op10_canonical_texts(spark):
    """As published, and wrapped anew at several widths, bare and as comments."""
    rows = []
    for name, (text, *_) in NOTICES.items():
        parts = text.strip().split("\n\n")
        rows.append((name, text))
        for width in (20, 33, 60, 79, 100_000):
            # titles and copyright lines stay lines of their own
            wrapped = ["\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in (p.split("\n") if p.startswith("Copyright") else [p])) for p in parts]
            for prefix in ("", "# ", " * ", "// "):
                rows.append((name, "\n".join(prefix + x for x in "\n\n".join(wrapped).split("\n"))))
    df = spark.createDataFrame(rows, "name string, text string")
    for r in licenses.scan_licenses(df).collect():
        assert (r.name, [x.license for x in r.licenses], r.open_ids, r.text) == (r.name, *NOTICES[r.name][1:], r.text)


def test_op10_every_sentence_has_a_cue(spark):
    known = [t for texts in licenses.SENTENCES.values() for t in texts] + ["copyright 2020", "spdx license identifier mit"]
    df = spark.createDataFrame([(t,) for t in known], "text string")
    assert df.where(F.size(licenses.sentence_ids(F.col("text"))) == 0).count() == 0


def test_tasks_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    work = common.giving_back(lambda batches: (x + 1 for x in batches))(iter([1, 2]))
    assert next(work) == 2 and not given
    assert list(work) == [3] and given == [1]
    texts = ["ab", None, "é" * 10, "x", "", "yz"]
    parts = list(common.byte_slices([pa.RecordBatch.from_pydict({"id": range(6), "text": texts})], limit=5))
    assert [p.column("id").to_pylist() for p, _ in parts] == [[0, 1], [2], [3, 4, 5]]
    assert [x for _, some in parts for x in some] == [(t or "").encode() for t in texts]


def test_weights_in_order():
    """A table of weights holds the arrays that it is given and no copy of them."""
    draw = np.random.default_rng(3)
    keys = np.unique(np.concatenate([draw.integers(1, 1 << 64, 5000, dtype=np.uint64), np.arange(1, 300, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(1, 300, dtype=np.uint64)]))
    draw.shuffle(keys)
    gain, leave = draw.random(len(keys), dtype=np.float32), draw.random(len(keys), dtype=np.float32)
    arrays = quality_lm.in_order(keys, gain, leave)
    table = quality_lm._Table(*arrays)
    assert table.keys is arrays[0] and table.gain is arrays[1] and table.leave is arrays[2]
    slot = table.slots(keys)
    assert (table.gain[slot] == gain).all() and (table.leave[slot] == leave).all()
    known = set(keys.tolist())
    other = np.array([x for x in draw.integers(1, 1 << 64, 3000, dtype=np.uint64).tolist() + [400, 2**64 - 400, 2**64 - 1] if x not in known], dtype=np.uint64)
    assert not table.gain[table.slots(other)].any() and not table.leave[table.slots(other)].any()
    none = np.zeros(0)
    table = quality_lm._Table(*quality_lm.in_order(none.astype(np.uint64), none.astype(np.float32), none.astype(np.float32)))
    assert not table.gain[table.slots(other)].any()


def test_written_in_small_batches(spark):
    """Long texts do not go to Python 10,000 at a time while an intermediate is made."""
    before = spark.conf.get(common.BATCH_SETTING)

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    texts = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    got = [r.n for r in common.written(texts.mapInArrow(rows, "n long"), "test").collect()]
    assert sum(got) == 1000 and max(got) <= 2 * common.BATCH_BYTES // 20_000
    assert spark.conf.get(common.BATCH_SETTING) == before


def test_pipeline(spark):
    before = spark.read.parquet(f"{DATA}/documents.parquet")
    table, seen = before, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, DATA)
        if k < 4:
            assert table.columns == before.columns
            table = quality_lm.written(table, "test")
            seen.append({r.doc_id for r in table.select("doc_id").collect()})
    assert seen[0] > seen[1] >= seen[2] == seen[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    # near-duplicates: one document of each group of what the first stage kept
    assert seen[1] == set(brute.similar_groups([(d, texts[d]) for d in seen[0]]).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    order = sorted(seen[1])
    assert seen[2] == {d for d, x in zip(order, brute.op5([texts[d] for d in order], items)) if not x[4]}
    rows = table.collect()
    assert {r.doc_id for r in rows} == seen[3]
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(tuple(r)[:5] for r in rows)


def test_pipeline_odd_rows(spark, odd):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, odd.limit(0), DATA).count() == 0
        out = stage(spark, odd, DATA)
        assert out.count() > 0 and (k == 4 or out.columns == odd.columns)
