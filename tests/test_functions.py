import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

import stepframe as sf

D = dt.date


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    "unit, a, b, how, want",
    [
        ("month", "2023-12-31", "2024-01-01", "boundary", 1),
        ("year", "2023-12-31", "2024-01-01", "boundary", 1),
        ("day", "2023-12-31", "2024-01-01", "boundary", 1),
        ("week", "2023-12-30", "2023-12-31", "boundary", 1),
        ("week", "2023-12-31", "2024-01-01", "boundary", 0),
        ("quarter", "2023-02-15", "2023-04-14", "boundary", 1),
        ("quarter", "2023-02-15", "2023-04-14", "elapsed", 0),
        ("week", "2024-01-10", "2024-01-02", "elapsed", -2),
        ("month", "2024-01-31", "2024-02-29", "continuous", 0),
        ("Years", "2000-02-29", "2001-02-28", "continuous", 0),
        ("year", "1990-11-20", "2023-11-20", "continuous", 33),
    ],
)
def test_intck(spark, unit, a, b, how, want):
    assert one(spark, sf.intck(unit, a, b, how)) == want


@pytest.mark.parametrize(
    "unit, d, n, align, want",
    [
        ("month", "2023-03-23", 0, "b", D(2023, 3, 1)),
        ("month", "2023-03-23", 0, "s", D(2023, 3, 23)),
        ("month", "2023-03-23", 0, "e", D(2023, 3, 31)),
        ("month", "2023-03-23", 0, "m", D(2023, 3, 15)),
        ("month", "2023-03-23", 1, "b", D(2023, 4, 1)),
        ("year", "2023-03-23", -1, "s", D(2022, 3, 23)),
        ("year", "2024-02-29", -1, "sameday", D(2023, 2, 28)),
        ("month", "2024-01-31", 1, "s", D(2024, 2, 29)),
        ("quarter", "2024-02-10", 1, "e", D(2024, 6, 30)),
        ("year", "2024-02-10", 0, "e", D(2024, 12, 31)),
        ("week", "2024-01-03", 0, "b", D(2023, 12, 31)),
        ("week", "2024-01-03", 1, "e", D(2024, 1, 13)),
        ("day", "2024-02-28", 2, "b", D(2024, 3, 1)),
    ],
)
def test_intnx(spark, unit, d, n, align, want):
    assert one(spark, sf.intnx(unit, d, n, align)) == want


def test_date_text(spark):
    d = F.lit(D(1990, 11, 20))
    got = {f: one(spark, sf.put(d, f)) for f in sf.FORMATS}
    assert got == {
        "date9.": "20NOV1990", "mmddyy8.": "11/20/90", "mmddyy10.": "11/20/1990", "ddmmyy10.": "20/11/1990",
        "monyy5.": "NOV90", "monname3.": "Nov", "monname.": "November", "year4.": "1990",
    }
    assert one(spark, sf.input_(F.lit("20NOV1990"), "date9.")) == D(1990, 11, 20)
    assert one(spark, sf.input_(F.lit("20Nov1990"), "date9.")) == D(1990, 11, 20)
    assert one(spark, sf.input_(F.lit("rubbish"), "date9.")) is None
    assert one(spark, sf.date_literal("23MAR2023")) == D(2023, 3, 23)
    assert one(spark, sf.from_daynum(F.lit(23011))) == D(2023, 1, 1)
    assert one(spark, sf.from_daynum(F.lit(22970))) == D(2022, 11, 21)
    assert one(spark, sf.to_daynum(F.lit(D(1960, 1, 1)))) == 0


def test_date_filters(spark):
    df = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 30),), (D(2024, 1, 31),), (D(2021, 12, 31),)], "d date")
    assert rows(df.where(sf.within_days(F.col("d"), 30, "2024-01-01"))) == [(D(2024, 1, 1),), (D(2024, 1, 30),)]
    assert len(rows(df.where(sf.since_months(F.col("d"), 24, "2024-01-31")))) == 3
    assert len(rows(df.where(sf.due_within(F.col("d"), 30, "2024-01-01")))) == 3


def test_strings(spark):
    assert one(spark, sf.scan(F.lit("FTB REMORTGAGE BUYTOLET"), 2)) == "REMORTGAGE"
    assert one(spark, sf.scan(F.lit("a  b"), 3)) is None
    assert one(spark, sf.scan(F.lit("a@b@"), -1, "@")) == "b"
    assert one(spark, sf.overwrite_all(F.lit("ABC DEF"), "MJ")) == "MMMMMMM"
    assert one(spark, sf.overwrite(F.lit("ABC"), 2, "MJ")) == "AMC"
    assert one(spark, sf.overwrite(F.lit("ABC"), 9, "MJ")) == "ABC"
    assert one(spark, sf.chars(F.lit("AB"), 4)) == ["A", "B", None, None]
    assert one(spark, sf.cats(F.lit(" a "), F.lit(None).cast("string"), F.lit(3))) == "a3"
    assert one(spark, sf.catx(" ", F.lit("a"), F.lit(""), F.lit("b "))) == "a b"
    assert one(spark, sf.length(F.lit("ab  "))) == 2
    assert one(spark, sf.placeholders(F.lit("&b &a &b"))) == ["&a", "&b"]


def test_numbers(spark):
    assert one(spark, sf.idiv(F.lit(10), F.lit(3))) == 3
    assert one(spark, sf.idiv(F.lit(-10), F.lit(3))) == -3
    assert one(spark, sf.idiv(F.lit(1), F.lit(0))) is None
    assert one(spark, sf.fdiv(F.lit(10), F.lit(3))) == pytest.approx(10 / 3)
    df = spark.createDataFrame([(1, None, 3), (None, None, None)], "a int, b int, c int")
    assert rows(df.select(sf.row_sum("abc"), sf.row_mean("abc"))) == [(None, None), (4, 2.0)]
    assert one(spark, sf.flag(F.lit(None).cast("int") > 90)) == 0
    assert one(spark, sf.ratio(F.lit(1), F.lit(0))) is None
    bands = [one(spark, sf.band(F.lit(s))) for s in (0.9, 0.7, 0.5, 0.49)]
    assert bands == ["Ready", "Review", "Manual review", "Failed"]


def test_definitions_last_one_wins(spark):
    df = spark.createDataFrame([(1, "%let a = x ; %LET b=2; data q; %let a=y;")], "id int, t string")
    assert rows(sf.pairs(df, "id", "t")) == [(1, "a", "y"), (1, "b", "2")]


def test_lines(spark):
    assert one(spark, sf.lines(F.lit("a\r\nb\n\nc\n"))) == ["a", "b", "", "c"]
    assert one(spark, sf.lines(F.lit(""))) == []
    df = spark.createDataFrame([(1, "x\n # TODO: one\n# TODO: two")], "id int, t string")
    assert rows(sf.marker_lines(df, "t", "# TODO:")) == [(1, "# TODO: one", 2), (1, "# TODO: two", 3)]


def test_assign_when(spark):
    df = spark.createDataFrame([(1, "o"), (5, "o"), (None, "o")], "v int, keep string")
    out = sf.assign_when(df, [(F.col("v") > 3, {"a": F.lit("big"), "keep": F.lit("n")})], else_={"b": F.lit(1)})
    assert rows(out) == [(None, "o", None, 1), (1, "o", None, 1), (5, "n", "big", None)]


def test_column_lists(spark):
    df = spark.createDataFrame([(None, None, "x")], "v1 int, v3 double, s string")
    assert sf.numbered(df, "v", 1, 20) == ["v1", "v3"] and sf.numeric_columns(df) == ["v1", "v3"]
    filled = sf.fill(df, sf.numeric_columns(df), 0)
    assert filled.dtypes == df.dtypes and rows(filled) == [(0, 0.0, "x")]
    assert sf.rename(df, {"v1": "v3", "v3": "v1"}).columns == ["v3", "v1", "s"]
    with pytest.raises(ValueError):
        sf.rename(df, {"zz": "a"})
    out = sf.set_format(sf.label(df, {"v1": "One"}), {"v1": "best."})
    assert out.schema["v1"].metadata == {"label": "One", "format": "best."}
