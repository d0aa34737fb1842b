from conftest import rows
from pyspark.sql import functions as F

import stepframe as sf


def test_flags_and_counter(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "cc string, seq int")
    assert rows(sf.by_flags(df, "cc", "seq"), "cc", "seq", "first_cc", "last_cc") == [
        ("A", 1, 1, 0), ("A", 2, 0, 1), ("B", 1, 1, 1)
    ]
    assert rows(sf.by_counter(df, "cc", "seq")) == [("A", 1, 1), ("A", 2, 2), ("B", 1, 1)]


def test_inner_flag_follows_outer_key(spark):
    df = spark.createDataFrame([("X", 1), ("Y", 1)], "type string, cc int")
    out = sf.by_flags(df.withColumn("seq", F.lit(1)), ["type", "cc"], "seq")
    assert rows(out, "type", "first_cc", "last_cc") == [("X", 1, 1), ("Y", 1, 1)]


def test_flags_with_missing_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("A", 1)], "cc string, seq int")
    assert rows(sf.by_flags(df, "cc", "seq"), "cc", "seq", "first_cc", "last_cc") == [
        (None, 1, 1, 0), (None, 2, 0, 1), ("A", 1, 1, 1)
    ]


def test_running_sum_missing_values(spark):
    df = spark.createDataFrame([(1, "A", None), (2, "A", 5), (3, "A", None), (4, "A", 2)], "seq int, k string, v int")
    assert [r[1] for r in rows(sf.running_sum(df, "v", "k", "seq", "t"), "seq", "t")] == [None, 5, 5, 7]
    assert [r[1] for r in rows(sf.running_sum(df, "v", None, "seq", "t"), "seq", "t")] == [0, 5, 5, 7]


def test_nested_variants(spark):
    df = spark.createDataFrame([("X", 1, 1), ("X", 1, 2), ("X", 2, 3)], "type string, cc int, seq int")
    assert rows(sf.nested_by_outer(df, "type", "cc", "seq"), "cc", "seq", "count") == [(2, 3, 3)]
    assert rows(sf.nested_by_inner(df, "type", "cc", "seq"), "cc", "seq", "count") == [(1, 2, 2), (2, 3, 1)]


def test_third_or_second(spark):
    df = spark.createDataFrame([(g, i) for g in range(1, 5) for i in range(1, g + 1)], "g int, i int")
    assert rows(sf.third_or_second(df, "g", "i")) == [(2, 2), (3, 3), (4, 3)]


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("k", 3), ("k", 3), ("k", 1)], "k string, v int")
    assert rows(sf.count_ge(df, "k", "v"), "v", "rank") == [(1, 3), (3, 2), (3, 2)]
    assert rows(sf.rank_min(df, "k", "v"), "v", "rank") == [(1, 3), (3, 1), (3, 1)]


def test_first_and_last_keep_whole_rows(spark):
    df = spark.createDataFrame([("k", 1, 7, None), ("k", 2, None, 8)], "k string, seq int, a int, b int")
    assert rows(sf.first_row(df, "k", "seq")) == [("k", 1, 7, None)]
    assert rows(sf.last_row(df, "k", "seq")) == [("k", 2, None, 8)]
    assert rows(sf.nth_row(df, "k", "seq", 2)) == [("k", 2, None, 8)]
    assert rows(sf.nth_row(df, "k", "seq", 3)) == []


def test_by_total_keeps_last_row(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), (None, 1, 4)], "k string, seq int, v int")
    out = sf.by_total(df, "k", "seq", {"total": F.sum("v")})
    assert rows(out) == [(None, 1, 4, 4), ("a", 2, 3, 5)]


def test_remerge(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9)], "dep string, sal int")
    top = sf.remerge(df, [], {"top": F.max("sal")}).where("sal = top")
    assert rows(top, "dep") == [("b",), ("c",)]
    keyed = spark.createDataFrame([(None, 1), (None, 3), ("a", 2)], "k string, v int")
    assert rows(sf.remerge(keyed, "k", {"m": F.max("v")})) == [(None, 1, 3), (None, 3, 3), ("a", 2, 2)]


def test_top_n_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    plan = sf.top_n(df, "k", "-v", 3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    exchange = physical.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in physical[:exchange] and "WindowGroupLimit" in physical[exchange:]


def test_row_index_has_no_single_task_window(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 10)
    out = sf.row_index(df, ["-v", "id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    main = plan[: plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning(__piece" in main and "SinglePartition" not in main
    assert sorted(r.row_num for r in out.collect()) == list(range(1, 1001))


def test_positions(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(1, 11)], "i int, sq int")
    assert [r[2] for r in rows(sf.point(df, [2, 1, 7, 4], "i"))] == [2, 1, 7, 4]
    sizes = sf.split_n(df, 4, "i").groupBy("part_no").count()
    assert rows(sizes) == [(1, 3), (2, 3), (3, 3), (4, 1)]
    assert rows(sf.head(df, 2, "-i"), "i") == [(9,), (10,)]
    assert rows(sf.tail(df, 1, "i"), "i") == [(10,)]
    one = df.limit(1).select(sf.first_value(df, "sq", "-i").alias("v"))
    assert rows(one) == [(100,)]


def test_order_is_required(spark):
    import pytest

    df = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError, match="order_by"):
        sf.by_counter(df, "k", [])
