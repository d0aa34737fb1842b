import datetime as dt

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import stepframe as sf

D = dt.date


def test_expand_months_over_a_year_end(spark):
    df = spark.createDataFrame(
        [(D(2023, 11, 20), D(2024, 2, 3)), (D(2024, 2, 1), D(2024, 1, 1)), (None, D(2024, 1, 1))], "s date, e date"
    )
    assert rows(sf.expand_months(df, "s", "e"), "month_start", "month_name") == [
        (D(2023, 11, 1), "NOVEMBER"), (D(2023, 12, 1), "DECEMBER"), (D(2024, 1, 1), "JANUARY"), (D(2024, 2, 1), "FEBRUARY")
    ]


def loop(spark, start, cond, until):
    df = spark.range(1).select(F.lit(start).alias("x0"))
    made = sf.generate(
        df, {"x": F.col("x0")}, cond, lambda s: {"x": s["x"] + 1}, until=until, output="before", max_steps=50
    )
    return [r[0] for r in rows(made, "x")]


def test_do_while_and_until(spark):
    assert loop(spark, 5, lambda s: s["x"] < 10, False) == [5, 6, 7, 8, 9]
    assert loop(spark, 12, lambda s: s["x"] < 10, False) == []
    assert loop(spark, 5, lambda s: s["x"] > 10, True) == [5, 6, 7, 8, 9, 10]
    assert loop(spark, 12, lambda s: s["x"] > 10, True) == [12]


def test_payment_schedule(spark):
    def pay(s):
        interest = s["balance"] * 0.005
        left = s["balance"] + interest - 1000
        return {"interest": interest, "balance": left.mask(left < 0, 0.0)}

    loan = spark.createDataFrame([(1,)], "id int")
    start = {"balance": F.lit(100000.0), "interest": F.lit(0.0)}
    made = sf.generate(loan, start, lambda s: s["balance"] > 0, pay, max_steps=200)
    last = rows(made.where("step_no >= 138").select("step_no", F.round("balance", 2), F.round("interest", 2)))
    assert made.count() == 139
    assert last == [(138, 970.93, 9.81), (139, 0.0, 4.85)]


def test_growth(spark):
    made = sf.generate(
        spark.range(1), {"amount": F.lit(1000.0)}, lambda s: s["amount"] >= 2000,
        lambda s: {"amount": s["amount"] * 1.07}, until=True,
    )
    out = rows(made.select("step_no", F.round("amount", 2)))
    assert len(out) == 11 and out[-1] == (11, 2104.85)


def test_endless_loop_is_an_error(spark):
    with pytest.raises(PySparkException, match="not finished after 20"):
        sf.generate(spark.range(1), {"x": F.lit(1)}, lambda s: s["x"] > 0, lambda s: {"x": s["x"] + 1}, max_steps=20).collect()


def test_long_loop_and_missing_states(spark):
    long = sf.generate(spark.range(0, 2, 1, 1), {"x": F.lit(0)}, lambda s: s["x"] < 30_000, lambda s: {"x": s["x"] + 1})
    assert tuple(long.agg(F.count("*"), F.max("x"), F.max("step_no")).first()) == (60_000, 30_000, 30_000)
    df = spark.createDataFrame([(1, None, "a"), (2, 3, None)], "k int, n int, t string")
    made = sf.generate(df, {"n": F.col("n"), "seen": F.lit(None).cast("string")}, lambda s: s["n"] <= 0, lambda s: {"n": s["n"] - 1}, until=True, max_steps=9)
    with pytest.raises(PySparkException, match="not finished after 9"):  # a missing condition never ends the loop
        made.collect()
    assert rows(made.sparkSession.createDataFrame(sf.generate(df, {"n": F.col("n")}, lambda s: s["n"] > 0, lambda s: {"n": s["n"] - 2}).collect(), "k int, t string, n int, step_no long")) == [(2, None, -1, 2), (2, None, 1, 1)]
    assert sf.generate(df.limit(0), {"n": F.col("n")}, lambda s: s["n"] > 0, lambda s: {"n": s["n"]}).columns == ["k", "t", "n", "step_no"]


def test_transpose(spark):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", None, 3.0)], "k string, x int, y double")
    long = sf.to_long(df, "k", ["x", "y"])
    assert rows(long) == [("a", "x", 1.0), ("a", "y", 2.5), ("b", "x", None), ("b", "y", 3.0)]
    wide = sf.to_wide(long, "k", "variable", "value", ["x", "y"])
    assert rows(wide) == [("a", 1.0, 2.5), ("b", None, 3.0)]
    with pytest.raises(PySparkException, match="two rows for one cell"):
        sf.to_wide(long.union(long), "k", "variable", "value", ["x", "y"]).collect()


def test_ranges(spark):
    assert rows(sf.rows(spark, 1, 3)) == [(1,), (2,), (3,)]
    df = spark.createDataFrame([(1, 2), (3, 2)], "a int, b int")
    assert rows(sf.expand_range(df, F.col("a"), F.col("b"))) == [(1, 2, 1), (1, 2, 2)]


def test_copies(spark):
    made = sf.copies(spark.range(2), "plate", 3)
    assert list(made) == ["plate1", "plate2", "plate3"] and made["plate3"].count() == 2
