"""What is delivered comes out whole: groups, hits, chunks, delimited records and rounds of a loop."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

import stepframe as sf


@pytest.mark.parametrize("piece", ["3", "2000000"])
@pytest.mark.parametrize("stats", [["p50"], ["p25", "p75"], ["n", "median"]])
def test_group_without_values_keeps_its_row(spark, piece, stats):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("b", None), ("c", 5.0), ("c", 6.0), ("c", 6.0)], "k string, v double")
    spark.conf.set("stepframe.pieceRows", piece)
    try:
        found = {r[0]: tuple(r[1:]) for r in sf.means(df, "v", stats, by="k").collect()}
        whole = sf.means(df.where("v IS NULL"), "v", stats).collect()
    finally:
        spark.conf.unset("stepframe.pieceRows")
    want = {"a": (1.5,), "b": (None,), "c": (6.0,)} if stats == ["p50"] else {"a": (1.25, 1.75), "b": (None, None), "c": (5.5, 6.0)} if len(stats[0]) == 3 else {"a": (2, 1.5), "b": (0, None), "c": (3, 6.0)}
    assert found == want and len(whole) == 1


def test_context_has_all_hits(spark):
    hits = spark.createDataFrame([(1, "k", i, "s", "", f"text {i}") for i in range(1, 8)], "q int, kind string, rank int, source string, pattern_name string, text string")
    text = sf.context(hits, "q", "kind").head().context
    assert "retrieved: 7" in text and all(f"text {i}" in text for i in range(1, 8))


def test_changed_documents_replace_their_chunks(spark):
    kind = "filepath string, section_index int, chunk_index int, text string"
    path = sf.scratch_path(spark, "chunks")
    sf.save_chunks(spark.createDataFrame([("f", 0, 0, "old"), ("f", 0, 1, "tail"), ("g", 0, 0, "g"), (None, 0, 0, "no name")], kind), path)
    new = spark.createDataFrame([("f", 0, 0, "NEW"), (None, 0, 0, "no name"), (None, 0, 0, "a name")], kind)
    for _ in range(2):
        assert rows(sf.save_chunks(new, path)) == [(None, 0, 0, "a name"), ("f", 0, 0, "NEW"), ("g", 0, 0, "g")]


def test_csv_keeps_text_as_it_is(spark):
    df = spark.createDataFrame([(1, "x\ny"), (2, ""), (3, None), (4, " a "), (5, 'q"q,q'), (6, "b\\"), (7, "\n"), (8, '"')], "i int, s string")
    path = sf.export({"t": df}, sf.scratch_path(spark, "csv"))[0]
    assert rows(sf.import_csv(spark, path, df.schema)) == rows(df)


@pytest.mark.parametrize("until", [False, True])
def test_long_loops_end(spark, until):
    df = spark.createDataFrame([(1500,), (3,), (0,), (32,), (33,), (64,), (None,)], "n int")
    made = sf.generate(df, {"x": F.lit(0)}, (lambda s: s["x"] >= 1500) if until else (lambda s: s["x"] < 40), lambda s: {"x": s["x"] + 1}, until=until)
    steps = 1500 if until else 40
    assert made.count() == 7 * steps
    assert made.groupBy("n").agg(F.max("x"), F.max("step_no")).distinct().where(f"`max(x)` <> {steps} OR `max(step_no)` <> {steps}").count() == 0


def test_loop_over_own_state(spark):
    df = spark.createDataFrame([(i, i * 7 % 90) for i in range(40)], "k int, n int")
    made = sf.generate(df, {"left": F.col("n")}, lambda s: s["left"] > 0, lambda s: {"left": s["left"] - 1})
    assert {r[0]: r[1] for r in made.groupBy("k").count().collect()} == {i: i * 7 % 90 for i in range(40) if i * 7 % 90}
