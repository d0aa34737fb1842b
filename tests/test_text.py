import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

import stepframe as sf
from stepframe.operators import metric_index


def test_sections(spark):
    text = "## Pattern 1: Alpha beta gamma\n---\nshort\n-----\n## Pattern 2. Delta epsilon zeta\n--\nx"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert rows(sf.sections(df), "section_index", "pattern_name") == [
        (0, "Alpha beta gamma"), (2, "Delta epsilon zeta")
    ]


def test_chunks_cover_the_text_and_end(spark):
    texts = ["x" * 100 + "\n\n" + "y" * 5000, "a\n" * 3000, " \n", "", "short", "z" * 2048, "w" * 1900 + "\n" + "v" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = sf.size_chunks(df).collect()
    assert max(len(r.text) for r in out) <= 2048
    got = {i: [r.text for r in sorted(out, key=lambda r: r.chunk_index) if r.id == i] for i in range(len(texts))}
    assert got[2] == [] and got[3] == [] and got[4] == ["short"] and got[5] == ["z" * 2048]
    assert got[0][0] == "x" * 100 and "".join(dict.fromkeys("".join(got[0]))) == "xy"
    for i, t in enumerate(texts):
        letters = [c for c in t if not c.isspace()]
        assert sum(len(c.replace("\n", "")) for c in got[i]) >= len(letters)


def test_chunks_are_cut_row_by_row(spark):
    """A Python worker holds a few texts, not an Arrow batch of up to 10,000 and all their chunks."""
    df = spark.range(300).select("id", F.expr("CASE WHEN id % 3 = 0 THEN repeat(concat('line ', id, '\n'), 900) WHEN id % 3 = 1 THEN 'short' END").alias("text"))
    out = sf.size_chunks(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert rows(sf.chunk_counts(out, by="id")) == sorted((i, len(c)) for i in range(300) if (c := _plain_chunks(i)))


def _plain_chunks(i):
    from stepframe.operators.chunking import _chunks_of

    return _chunks_of(f"line {i}\n" * 900, 2048, 256, False) if i % 3 == 0 else ["short"] if i % 3 == 1 else []


def test_tail_of_an_overlap(spark):
    df = spark.createDataFrame([(1, "q" * 2047 + "\n" + "r" * 1900)], "id int, text string")
    short, full = sf.size_chunks(df).collect(), sf.size_chunks(df, keep_tail=True).collect()
    assert len(full) == len(short) + 1 and full[-1].text == short[-1].text[-len(full[-1].text):]
    assert len(full[-1].text) <= 256


def test_window_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, "")], "id int, text string")
    assert rows(sf.window_chunks(df, size=4, overlap=1)) == [
        (1, "abcd", 0), (1, "defg", 1), (1, "ghij", 2), (2, "abc", 0)
    ]


def test_document_chunks(spark):
    df = spark.createDataFrame([("/d/one.md", "## Pattern 3: Name\nbody of the section\n---\nno")], "filepath string, text string")
    assert rows(sf.document_chunks(df)) == [
        ("one.md", "/d/one.md", "Name", 0, 0, "## Pattern 3: Name\nbody of the section")
    ]


def brute(q, v, k):
    return {
        qi: [int(i) for i in np.lexsort((list(v), ((np.array(list(v.values())) - vec) ** 2).sum(1)))[:k]]
        for qi, vec in q.items()
    }


def test_nearest_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    vecs = {i: [rnd.choice([0.0, 0.5, 1.0]) for _ in range(4)] for i in range(300)}
    df = spark.createDataFrame(list(vecs.items()), "vec_id bigint, embedding array<float>").repartition(5)
    want = brute(vecs, vecs, 6)

    def found():
        out = sf.nearest(df, df, k=6, query_id="vec_id").collect()
        return {q: [r.vector_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in vecs}

    assert found() == want
    monkeypatch.setattr(metric_index, "BLOCK_ROWS", 20)  # many blocks, cells dealt over several, many chunks
    monkeypatch.setattr(metric_index, "CHUNK_ROWS", 70)
    assert found() == want
    monkeypatch.setattr(metric_index, "MAX_PROBES", 3)  # fewer than k: no bound from the sample
    assert found() == want


def test_nearest_rules_out_most_pairs_of_clustered_vectors(spark):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(0, 10, (25, 16))
    mat = centres[rnd.integers(0, 25, 4000)] + rnd.normal(0, 0.3, (4000, 16))
    mat[1000:2333] = mat[0]  # a third of all rows is one vector
    vecs = {i: [float(x) for x in v] for i, v in enumerate(mat)}
    df = spark.createDataFrame(list(vecs.items()), "vec_id bigint, embedding array<double>").repartition(4)
    few = df.where("vec_id % 10 = 0")
    work = sf.pairs_measured(few, df, query_id="vec_id").first()
    assert work.pairs == 400 * 4000 and work.measured < 0.2 * work.pairs
    got = {}
    for r in sf.nearest(few, df, query_id="vec_id").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vector_id)
    assert got == brute({i: vecs[i] for i in range(0, 4000, 10)}, vecs, 4)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "vec_id string, embedding array<float>")
    one = sf.nearest(df, df, query_id="vec_id")
    assert rows(one) == [("a", 1, "a", 0.0)]
    for q, v in ((df, df.limit(0)), (df.limit(0), df)):
        assert sf.nearest(q, v, query_id="vec_id").columns == one.columns and sf.nearest(q, v, query_id="vec_id").count() == 0
    assert rows(sf.pairs_measured(df, df.limit(0), query_id="vec_id")) == [(0, 0)]


def test_nearest_ships_the_smaller_side(spark):
    rnd = random.Random(4)
    vecs = {i: [rnd.choice([0.0, 1.0]) for _ in range(3)] for i in range(200)}  # many equal vectors
    few = {i: vecs[i] for i in range(0, 200, 23)}
    schema = "vec_id bigint, embedding array<float>"
    many_df = spark.createDataFrame(list(vecs.items()), schema).repartition(3)
    few_df = spark.createDataFrame(list(few.items()), schema)
    for q, v, qs, vs in ((many_df, few_df, vecs, few), (few_df, many_df, few, vecs)):
        out = sf.nearest(q, v, k=4, query_id="vec_id").collect()
        got = {i: [r.vector_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == i] for i in qs}
        ids, mat = np.array(list(vs)), np.array(list(vs.values()))
        assert got == {i: [int(x) for x in ids[np.lexsort((ids, ((mat - x0) ** 2).sum(1)))[:4]]] for i, x0 in qs.items()}


def test_context_and_fallback(spark):
    hits = spark.createDataFrame(
        [(1, "k", 2, "b.md", None, " two "), (1, "k", 1, "a.md", "Alpha", "one")],
        "q int, kind string, rank int, source string, pattern_name string, text string",
    )
    assert sf.context(hits, "q", "kind").first().context == (
        "=== RAG CONTEXT FOR CODE GEN ===\n\nBlock type: k\nRelevant patterns retrieved: 2\n\n"
        "Pattern 1 (from a.md): Alpha\none\n\nPattern 2 (from b.md)\ntwo\n\n=== END RAG CONTEXT ==="
    )
    queries = spark.createDataFrame([(1, "k"), (2, "k"), (3, "macro"), (4, "z")], "q int, kind string")
    out = sf.with_fallback(hits.select("q", "text"), queries, "q", "kind", {"k": "guide"})
    assert rows(out.select("q", "text").distinct()) == [
        (1, " two "), (1, "one"), (2, "guide"), (4, "No specific guidance available.")
    ]


def test_tags(spark):
    df = spark.createDataFrame([("if FIRST.x; retain y; (select 1)",), ("none",)], "t string")
    assert [r[0] for r in df.select(sf.tag(F.col("t"), sf.TAG_RULES)).collect()] == [
        ["FIRST LAST retain group by", "RETAIN running sum cumsum", "subquery NOT IN anti-join correlated"], []
    ]
