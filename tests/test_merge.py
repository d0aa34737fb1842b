import pytest
from conftest import rows
from pyspark.sql import functions as F

import stepframe as sf


def test_left_only_keeps_columns(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    right = spark.createDataFrame([(2, "c")], "id int, c string")
    out = sf.merge([left, right], "id", keep="left_only")
    assert out.columns == ["id", "c"] and rows(out) == [(1, None)]
    assert rows(sf.merge([left, right], "id", keep="left_only", flags=["a", "b"])) == [(1, None, 1, 0)]


@pytest.mark.parametrize("split", [False, True])
def test_last_dataset_wins_where_it_contributed(spark, split):
    left = spark.createDataFrame([(1, 10), (2, 20)], "id int, x int")
    right = spark.createDataFrame([(1, None)], "id int, x int")
    assert rows(sf.merge([left, right], "id", split_hot=split)) == [(1, None), (2, 20)]


@pytest.mark.parametrize("split", [False, True])
def test_one_to_many(spark, split):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "rollno int, v string")
    right = spark.createDataFrame(
        [(1, "Ram", 2), (2, "Shyam", 34), (2, "kaka", 53), (3, "same31", 53), (3, "same32", 54)],
        "rollno int, name string, age int",
    )
    assert rows(sf.merge([left, right], "rollno", split_hot=split), "rollno", "v", "name") == [
        (1, "a", "Ram"), (2, "b", "Shyam"), (2, "b", "kaka"), (3, None, "same31"), (3, None, "same32")
    ]


@pytest.mark.parametrize("split", [False, True])
def test_missing_keys_match(spark, split):
    left = spark.createDataFrame([(None, 1), (1, 2)], "id int, a int")
    right = spark.createDataFrame([(None, 3)], "id int, b int")
    assert rows(sf.merge([left, right], "id", split_hot=split)) == [(None, 1, 3), (1, 2, None)]


def test_three_datasets_and_condition(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "id int, a int")
    b = spark.createDataFrame([(2, 2), (3, 2)], "id int, b int")
    d = spark.createDataFrame([(3, 3), (1, 3)], "id int, d int")
    out = sf.merge([a, b, d], "id", flags=["x", "y", "z"])
    assert rows(out) == [(1, 1, None, 3, 1, 0, 1), (2, 1, 2, None, 1, 1, 0), (3, None, 2, 3, 0, 1, 1)]
    kept = sf.merge([a, b, d], "id", keep=(F.col("x") == 1) & (F.col("z") == 0), flags=["x", "y", "z"])
    assert rows(kept, "id") == [(2,)]


def test_not_in(spark):
    feb = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    jan = spark.createDataFrame([(2,), (None,)], "k int")
    assert rows(sf.not_in(feb, jan, "k")) == [(1,)]


def test_wrong_arguments(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError):
        sf.merge([df], "id")
    with pytest.raises(ValueError):
        sf.merge([df, df], "id", keep="outer")
    with pytest.raises(ValueError):
        sf.merge([df, df, df], "id", keep="left")


def test_stack(spark):
    x = spark.createDataFrame([(1, 2)], "a int, b int")
    y = spark.createDataFrame([(3, 4)], "a int, c int")
    out = sf.stack(x, y)
    assert out.columns == ["a", "b", "c"] and rows(out) == [(1, 2, None), (3, None, 4)]


def test_self_lookup(spark):
    staff = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 9)], "id int, name string, boss int")
    out = sf.lookup_self(staff, "id", "boss", {"name": "manager"})
    assert rows(out, "id", "manager") == [(1, None), (2, "a"), (3, None)]


def test_merge_stays_a_hash_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(10).withColumnRenamed("id", "k")
        plan = sf.merge([df.withColumn("a", F.lit(1)), df.withColumn("b", F.lit(1))], "k")
        text = plan._jdf.queryExecution().toString()
        assert "SortMergeJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_columns_of_other_types_are_named(spark):
    left = spark.createDataFrame([(1, 1.5, "a")], "k int, x double, s string")
    right = spark.createDataFrame([(1, 2, "2024-01-01")], "k bigint, x int, s string")
    assert rows(sf.merge([left, right], "k"), "k", "x", "s") == [(1, 2.0, "2024-01-01")]
    with pytest.raises(ValueError, match="column s is string in one dataset and date in another"):
        sf.merge([left, right.withColumn("s", F.col("s").cast("date"))], "k")
    with pytest.raises(ValueError, match="column k is int"):
        sf.merge([left, right.withColumn("k", F.col("k").cast("string"))], "k", keep="left_only")
