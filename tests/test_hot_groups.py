"""Split groups must give exactly what one big window gives."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

import stepframe as sf
from stepframe.operators import spread
from stepframe.operators.keys import sort_columns, total_order

ORDERS = [["ts", "id"], ["-ts", "id"], ["-label", "ts", "-id"]]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key; keys, order values and amounts are missing at times."""
    rnd = random.Random(5)
    data = []
    for i in range(1200):
        key = "hot" if i % 3 == 0 else rnd.choice([None, "a", "b", "c", "d", "e", "f", "g", "h"])
        ts = None if rnd.random() < 0.05 else rnd.randrange(40)
        amount = None if rnd.random() < 0.3 else rnd.randrange(100)
        data.append((i, key, rnd.choice(["x", "y"]), ts, None if rnd.random() < 0.1 else rnd.choice("pqrs"), amount))
    df = spark.createDataFrame(data, "id int, key string, sub string, ts int, label string, amount bigint")
    return df.cache()


def window(df, by, order):
    return Window.partitionBy(*by).orderBy(*sort_columns(total_order(df, by, order, ties=False)))


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("by", [[], ["key"], ["key", "sub"]])
def test_row_number(skewed, small_pieces, by, order):
    want = skewed.withColumn("n", F.row_number().over(window(skewed, by, order)).cast("bigint"))
    got = sf.row_number(skewed, by, order, "n", ties=False)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("by", [[], ["key"]])
def test_running_sum(skewed, small_pieces, by, order):
    total = F.sum("amount").over(window(skewed, by, order).rowsBetween(Window.unboundedPreceding, 0))
    if not by:
        total = F.coalesce(total, F.lit(0))
    assert rows(sf.running_sum(skewed, "amount", by, order, "t", ties=False)) == rows(skewed.withColumn("t", total))


@pytest.mark.parametrize("n", [1, 3, 60, 150])
@pytest.mark.parametrize("by", [[], ["key"]])
def test_lag(skewed, small_pieces, by, n):
    for order in ORDERS[:2]:
        want = skewed.withColumn("p", F.lag("amount", n).over(window(skewed, by, order)))
        got = sf.lag(skewed, "amount", n, order, by, "p", ties=False)
        assert rows(got) == rows(want)


def test_flags(skewed, small_pieces, spark):
    got = sf.by_flags(skewed, ["key", "sub"], ["ts", "id"], ties=False)
    spark.conf.set("stepframe.pieceRows", "100000")
    assert rows(got) == rows(sf.by_flags(skewed, ["key", "sub"], ["ts", "id"], ties=False))
    w = window(skewed, ["key", "sub"], ["ts", "id"])
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(0)
    assert rows(got, "id", "first_sub") == rows(skewed.select("id", first.alias("first_sub")))


def test_ranks(skewed, small_pieces):
    w = Window.partitionBy("key").orderBy(F.col("amount").desc_nulls_last())
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    assert rows(sf.count_ge(skewed, "key", "amount", "r")) == rows(
        skewed.withColumn("r", F.count("amount").over(upto))
    )
    assert rows(sf.rank_min(skewed, "key", "amount", "r")) == rows(
        skewed.withColumn("r", F.rank().over(w).cast("bigint"))
    )


def test_quantiles(skewed, small_pieces, spark):
    args = (["amount", "ts"], ["n", "p25", "median", "p75", "mean"])
    for by in (None, "key", ["key", "sub"]):
        spark.conf.set("stepframe.pieceRows", "50")
        got = rows(sf.means(skewed, *args, by=by))
        spark.conf.set("stepframe.pieceRows", "100000")
        want = rows(sf.means(skewed, *args, by=by))
        assert [[pytest.approx(v) if isinstance(v, float) else v for v in r] for r in want] == [list(r) for r in got]


def test_quantiles_by_counting(spark):
    """Ranks inside, at the edge of and beside a value with very many copies; a group of one value; missing keys."""
    rnd = random.Random(8)
    data = [(rnd.choice(["a", None]), rnd.choice([7.0, 7.0, rnd.gauss(7, 1), -0.0, 1e300])) for _ in range(3000)]
    data += [("one", 3.5)] * 400 + [("few", float(k)) for k in range(5)] + [("none", None)] * 3
    df = spark.createDataFrame(data, "k string, x double").cache()
    probs = [0.0, 0.001, 0.2, 0.25, 0.39, 0.4, 0.5, 0.75, 0.8, 0.999, 1.0]
    want = {r.k: r.x for r in df.where("x IS NOT NULL").groupBy("k").agg(F.percentile("x", probs).alias("x")).collect()}
    spark.conf.set("stepframe.pieceRows", "50")
    try:
        got = {r.k: [r[f"__q_0_{j}"] for j in range(len(probs))] for r in sf.exact_quantiles(df, ["x"], probs, ["k"]).collect()}
        none = sf.exact_quantiles(df.where("x > 1e301"), ["x"], [0.5], []).collect()
    finally:
        spark.conf.unset("stepframe.pieceRows")
    assert got == want
    assert [tuple(r) for r in none] == [(None,)]


@pytest.mark.parametrize("keep", ["all", "left", "right", "both", "left_only", "right_only"])
def test_merge(skewed, small_pieces, keep):
    right = skewed.where("id % 7 = 0 AND coalesce(key, '') <> 'c'").select("key", F.lit("r").alias("mark"), "amount")
    right = right.unionByName(skewed.sparkSession.createDataFrame([("zz", "r", 1)], right.schema))
    left = skewed.where("coalesce(key, '') <> 'd'").select("key", "id", "amount")
    plain = sf.merge([left, right], "key", keep=keep, split_hot=False)
    split = sf.merge([left, right], "key", keep=keep)
    assert split.columns == plain.columns
    assert rows(split) == rows(plain)
    flagged = sf.merge([left, right], "key", keep=keep, flags=["l", "r"])
    assert rows(flagged.drop("l", "r")) == rows(plain)


def test_many_cuts_use_the_array_search(skewed, small_pieces, monkeypatch):
    monkeypatch.setattr(spread, "_TREE_CUTS", 0)
    for by in ([], ["key"]):
        want = skewed.withColumn("n", F.row_number().over(window(skewed, by, ["-ts", "id"])).cast("bigint"))
        assert rows(sf.row_number(skewed, by, ["-ts", "id"], "n", ties=False)) == rows(want)


def test_pieces_are_small(skewed, small_pieces):
    sp = spread.Spread(skewed, ["key"], total_order(skewed, ["key"], ["ts", "id"], ties=False))
    assert sp.split
    largest = sp.frame.where(f"{spread.PIECE} IS NOT NULL").groupBy("key", spread.PIECE).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * small_pieces
    whole = sp.frame.where(f"{spread.PIECE} IS NULL").groupBy("key").count().agg(F.max("count")).first()[0]
    assert (whole or 0) <= 2 * small_pieces


def test_retain_fold_is_one_stream_per_group(skewed, spark):
    def step(s, r):
        return s * 0.5 + r.amount if r.amount is not None and r.amount > 50 else s + 1

    data = skewed.select("id", "key", "ts", "amount")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # the state is carried over many batches
    try:
        got = {r.id: r.state for r in sf.retain_fold(data, "key", ["ts", "id"], 0.0, step, using=["amount"], ties=False).collect()}
        whole = sf.retain_fold(data, None, "id", 0, lambda n, r: n + 1, "bigint", "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state, want = {}, {}
    for r in sorted(data.collect(), key=lambda r: (r.ts is not None, r.ts or 0, r.id)):
        want[r.id] = state[r.key] = step(state.get(r.key, 0.0), r)
    assert got == want
    assert {r.id: r.n for r in whole} == {i: i + 1 for i in range(1200)}


def test_retain_fold_odd_keys_and_types(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (None, 3), (None, 4), (0.5, 5)], "k double, v int")
    out = sf.retain_fold(df, "k", "v", "", lambda s, r: s + str(r.v), "string", "seen")
    assert {r.v: r.seen for r in out.collect()} == {1: "1", 2: "12", 3: "3", 4: "34", 5: "5"}
    assert sf.retain_fold(df.limit(0), "k", "v", 0.0, lambda s, r: s).count() == 0


@pytest.mark.parametrize("by", [[], ["key"]])
def test_totals_of_doubles_do_not_depend_on_pieces(skewed, spark, by):
    """Same bits whole, in pieces and in single rows, and equal to the exact sum rounded once."""
    value = F.when(F.col("id") % 11 != 0, F.pow(F.lit(-1.7), F.col("id") % 17) * (F.col("id") + 0.1) / 3)
    df = skewed.select("id", "key", value.alias("v")).cache()

    def totals():
        return {r.id: r.t for r in sf.running_sum(df, "v", by, "id", "t", ties=False).collect()}

    found = []
    for pieces in ("100000", "50", "170"):
        spark.conf.set("stepframe.pieceRows", pieces)
        found.append(totals())
    spark.conf.unset("stepframe.pieceRows")
    assert found[0] == found[1] == found[2]
    seen, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        values = seen.setdefault(r.key if by else 0, [])
        values += [r.v] if r.v is not None else []
        want[r.id] = math.fsum(values) if values or not by else None
    assert found[0] == want


def test_totals_of_odd_doubles(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, "a", inf), (2, "a", 1.0), (3, "b", inf), (4, "b", -inf), (5, "c", nan), (6, "d", None), (7, "d", 5e-300), (8, "e", -1e300), (9, "e", 1e300)], "id int, k string, v double")
    got = {r.id: r.t for r in sf.running_sum(df, "v", "k", "id", "t").collect()}
    assert got[2] == got[3] == inf and got[4] != got[4] and got[5] != got[5] and got[6] is None and got[9] == 0.0
    small = spark.createDataFrame([(1, 5e-320), (2, 5e-320)], "id int, v double")
    assert sorted(r.t for r in sf.running_sum(small, "v", None, "id", "t").collect()) == [5e-320, 1e-319]


def test_neighbours_over_a_thousand_pieces(spark):
    df = spark.range(2000).select("id", (F.col("id") * 7 % 11).alias("v"), F.lit("one").alias("key"))
    spark.conf.set("stepframe.pieceRows", "2")
    try:
        assert {r.id: r.p for r in sf.lag(df, "v", 5, "id", "key", "p", ties=False).collect()} == {i: (i - 5) * 7 % 11 if i > 4 else None for i in range(2000)}
        flags = sf.by_flags(df.withColumn("sub", F.floor(F.col("id") / 4)), ["key", "sub"], "id", ties=False).agg(F.sum("first_sub"), F.sum("last_sub"), F.sum("first_key")).first()
        assert tuple(flags) == (500, 500, 1)
    finally:
        spark.conf.unset("stepframe.pieceRows")


def test_retry_gives_the_same_pieces(skewed, small_pieces):
    """A piece depends on the row's own values only, not on how rows are distributed."""
    keys = total_order(skewed, ["key"], ["ts", "id"], ties=False)
    sp = spread.Spread(skewed, ["key"], keys)
    a = {r.id: r[spread.PIECE] for r in sp.frame.collect()}
    shuffled = sp.frame.repartition(7, "label").collect()
    assert {r.id: r[spread.PIECE] for r in shuffled} == a


def test_tables_without_rows(spark, small_pieces):
    none = spark.createDataFrame([], "key string, v int")
    assert rows(sf.row_index(none, "v")) == []
    assert rows(sf.row_number(none, "key", "v")) == []
    assert rows(sf.by_flags(none, "key", "v")) == []


def test_hot_copies(spark, small_pieces):
    """A third of all rows are copies of one row: they are spread over pieces too."""
    data = [("a", 1)] * 400 + [("a", i % 60) for i in range(400)] + [(k, i % 7) for i in range(200) for k in "bc"]
    df = spark.createDataFrame(data, "key string, v int")
    for by in ([], ["key"]):
        keys = total_order(df, by, "v")
        sp = spread.Spread(df, by, keys)
        assert spread._COPY in sp.frame.columns
        sizes = sp.frame.where(f"{spread.PIECE} IS NOT NULL").groupBy(*by, spread.PIECE).count()
        assert sizes.agg(F.max("count")).first()[0] <= 250
        w = Window.partitionBy(*by).orderBy("key", "v") if not by else Window.partitionBy("key").orderBy("v")
        order = ["key", "v"] if not by else ["v"]
        want = df.withColumn("n", F.row_number().over(w).cast("bigint"))
        assert rows(sf.row_number(df, by, order, "n")) == rows(want)
    total = F.sum("v").over(Window.partitionBy("key").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    assert rows(sf.running_sum(df, "v", "key", "v", "t")) == rows(df.withColumn("t", total))


def test_number_copies(spark):
    df = spark.createDataFrame([("x",)] * 7 + [("y",)] + [(None,)] * 2, "k string")
    got = rows(spread.number_copies(df, "i", block=3))
    assert got == [(None, 0), (None, 1)] + [("x", i) for i in range(7)] + [("y", 0)]


def test_large_top_n(skewed, small_pieces, monkeypatch):
    from stepframe.operators import bygroup

    want = rows(sf.top_n(skewed, "key", ["ts", "id"], 120, "r", ties=False))
    monkeypatch.setattr(bygroup, "_PRUNED", 10)
    assert rows(sf.top_n(skewed, "key", ["ts", "id"], 120, "r", ties=False)) == want


def test_sort_with_hot_copies(spark, small_pieces):
    df = spark.createDataFrame([("a", 1)] * 300 + [("b", i) for i in range(90)], "k string, v int")
    out = sf.sort(df, ["-k"])
    assert "__copy" in out._jdf.queryExecution().toString()
    got = [tuple(r) for r in out.collect()]
    assert [r[0] for r in got] == ["b"] * 90 + ["a"] * 300 and sorted(got) == rows(df)


def test_flags_with_hot_copies(spark, small_pieces):
    df = spark.createDataFrame([("a", 1)] * 300 + [("b", 1)] * 3, "k string, v int")
    got = rows(sf.by_flags(df, "k", "v"))
    assert got.count(("a", 1, 1, 0)) == 1 and got.count(("a", 1, 0, 1)) == 1 and got.count(("a", 1, 0, 0)) == 298
    assert got[-3:] == [("b", 1, 0, 0), ("b", 1, 0, 1), ("b", 1, 1, 0)]
