import pytest
from conftest import rows
from pyspark.sql import functions as F

import stepframe as sf


def test_one_row_statistics(spark):
    df = spark.createDataFrame([("k", 4.0)], "k string, x double")
    assert rows(sf.means(df, "x", ["n", "mean", "std", "var", "cv", "median"], by="k")) == [
        ("k", 1, 4.0, None, None, None, 4.0)
    ]


def test_missing_classes(spark):
    df = spark.createDataFrame([(None, 1), ("a", 1), ("a", None)], "k string, v int")
    assert rows(sf.means(df, "v", ["n"], by="k")) == [("a", 1)]
    assert rows(sf.means(df, "v", ["n"], by="k", include_missing=True)) == [(None, 1), ("a", 1)]
    assert rows(sf.freq(df, "k")) == [("a", 2)]
    assert rows(sf.freq(df, "k", include_missing=True)) == [(None, 1), ("a", 2)]


def test_crosstab_is_filled_with_zero(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "r string, c string")
    out = sf.freq(df, ["r", "c"], wide=True)
    assert out.columns == ["r", "x", "y"] and rows(out) == [("a", 1, 1), ("b", 2, 0)]


def test_nth_highest_counts_distinct_values(spark):
    df = spark.createDataFrame([(9,), (9,), (7,), (None,)], "v int")
    assert rows(sf.nth_highest(df, "v", 2)) == [(7,)]
    assert rows(sf.nth_highest(df, "v", 3)) == [(None,)]


def test_into_list(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert df.limit(1).select(sf.into_list(df, "v", "@")).first()[0] == "a@b"


def test_unknown_statistic(spark):
    with pytest.raises(ValueError, match="unknown statistics"):
        sf.means(spark.range(1), "id", ["mode"])


def test_names_and_long_form(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert sf.means(df, ["a", "b"], ["mean"], names={"mean": ["x", "y"]}).columns == ["x", "y"]
    assert rows(sf.describe(df, ["a"])) == [("a", 2.0, 2.0, pytest.approx(2**0.5), 1.0, 1.5, 2.0, 2.5, 3.0)]


def test_nodupkey_is_reproducible(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), (None, 5, "q")], "k string, v int, s string")
    assert rows(sf.nodupkey(df, "k")) == [(None, 5, "q"), ("k", 1, "a")]
    assert rows(sf.nodupkey(df, "k", "-v")) == [(None, 5, "q"), ("k", 2, "b")]


def test_sort_puts_missing_lowest(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    assert [r.v for r in sf.sort(df, "v").collect()] == [None, 1, 2]
    assert [r.v for r in sf.sort(df, "-v").collect()] == [2, 1, None]


def test_distinct_sketches_unite(spark):
    data = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 > 0, F.col("id") % 20_000).alias("user"), (F.col("id") % 11 / 2).alias("rate"))
    data = data.withColumn("day", F.when(F.col("day") > 0, F.col("day")))
    per_day = sf.distinct_sketches(data, ["user", "rate"], "day")
    assert per_day.count() == 6
    exact = data.where("day IS NOT NULL").agg(F.count_distinct("user"), F.count_distinct("rate")).head()
    whole = sf.sketch_counts(sf.unite_sketches(per_day)).head()
    assert abs(whole.user_distinct - exact[0]) <= 4 * sf.distinct_error() * exact[0] and whole.rate_distinct == exact[1] == 11
    # copies change nothing, and union in one step or two is the same
    assert sf.sketch_counts(sf.distinct_sketches(data.where("day IS NOT NULL").unionAll(data), ["user", "rate"], "day")).orderBy("day").collect() == sf.sketch_counts(per_day).orderBy("day").collect()
    empty = sf.sketch_counts(sf.distinct_sketches(data.limit(0), "user")).collect()
    assert [r.user_distinct for r in empty] == [0]
    assert sf.sketch_counts(sf.distinct_sketches(data, "user", "day", include_missing=True)).count() == 7
