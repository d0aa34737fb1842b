import datetime as dt

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

import stepframe as sf


def test_names(spark):
    sf.save(spark.range(3), "kept")
    assert sf.read(spark, "kept").count() == 3
    sf.save(spark.range(2), "kept")
    assert sf.read(spark, "kept").count() == 2
    assert sf.read(spark, "nation", DATA).count() == 25


def test_two_level_name(spark):
    base = sf.scratch_path(spark, "db")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS mj LOCATION '{base}'")
    sf.save(spark.range(4), "mj.sorted", table=True)
    assert sf.read(spark, "mj.sorted").count() == 4
    spark.sql("DROP TABLE mj.sorted")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export_and_import(spark, fmt):
    df = spark.createDataFrame([(1, 'a "q", b', dt.date(2024, 1, 2)), (2, None, None)], "i int, s string, d date")
    path = sf.export({"t": df}, sf.scratch_path(spark, "export"), fmt)[0]
    back = sf.import_csv(spark, path, df.schema) if fmt == "csv" else spark.read.parquet(path)
    assert rows(back) == rows(df)


def test_csv_without_line_ends_is_read_in_parts(spark):
    path = sf.export({"t": spark.range(0, 20_000, 1, 1).selectExpr("id", "concat('a \"quoted\", text ', id) AS s")}, sf.scratch_path(spark, "csv"))[0]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        back = sf.import_csv(spark, path, "id bigint, s string")
        assert back.rdd.getNumPartitions() > 3
        assert rows(back)[17] == (17, 'a "quoted", text 17') and back.count() == back.distinct().count() == 20_000
        assert sf.import_csv(spark, path, "id bigint, s string", line_ends=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_records_are_errors(spark):
    path = sf.export({"t": spark.createDataFrame([(1, "x\ny")], "i int, s string")}, sf.scratch_path(spark, "csv"))[0]
    with pytest.raises(Exception, match="(?i)malformed"):
        sf.import_csv(spark, path, "i int, s string", line_ends=False).select("i").collect()


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"one\r\n\ntwo\n")
    (tmp_path / "b.TXT").write_text("three")
    (tmp_path / "big.txt").write_text("line\n" * 50_000)
    (tmp_path / "c.csv").write_text("no")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        out = sf.read_text_lines(spark, str(tmp_path)).withColumn("name", F.regexp_extract("filepath", "[^/]*$", 0)).cache()
        assert rows(out.where("name <> 'big.txt'"), "name", "line") == [("a.md", ""), ("a.md", "one\r"), ("a.md", "two"), ("b.TXT", "three")]
        big = out.where("name = 'big.txt' AND line = 'line'")
        assert big.count() == 50_000 and big.select("part").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_inline_rows(spark):
    text = """
    1 Ram   20NOV1990
    2 .     01Jan2000
    x Kaka  nodate
    ;
    """
    out = sf.datalines(spark, text, "rollno int, name string, dob date")
    assert rows(out) == [(None, "Kaka", None), (1, "Ram", dt.date(1990, 11, 20)), (2, None, dt.date(2000, 1, 1))]


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("one\ntwo\n")
    (tmp_path / "sub" / "b.TXT").write_text("three")
    (tmp_path / "c.csv").write_text("no")
    out = sf.read_texts(spark, str(tmp_path))
    assert [(f.rsplit("/", 1)[1], t) for f, t in rows(out)] == [("a.md", "one\ntwo\n"), ("b.TXT", "three")]


def test_chunk_collection(spark):
    one = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "y")], "filepath string, section_index int, chunk_index int, text string")
    more = spark.createDataFrame([("a", 0, 1, "y"), ("b", 0, 0, "z")], one.schema)
    path = sf.scratch_path(spark, "collection")
    assert sf.save_chunks(one, path).count() == 2
    assert sf.save_chunks(one, path).count() == 2
    assert rows(sf.save_chunks(more, path), "filepath", "chunk_index") == [("a", 1), ("b", 0)]  # what is delivered of a document replaces it
    assert sf.save_chunks(more, path, rebuild=True).count() == 2


def test_compacted_collection_holds_latest_versions_only(spark):
    kind = "filepath string, section_index int, chunk_index int, text string"
    path, to = sf.scratch_path(spark, "collection"), sf.scratch_path(spark, "compact")
    sf.save_chunks(spark.createDataFrame([("a", 0, 0, "old"), ("a", 0, 1, "tail"), (None, 0, 0, "n")], kind), path)
    sf.save_chunks(spark.createDataFrame([("a", 0, 0, "new")], kind), path)
    got = sf.compact_chunks(spark, path, to)
    assert rows(got) == rows(sf.read_chunks(spark, path)) == [(None, 0, 0, "n"), ("a", 0, 0, "new")]
    assert spark.read.parquet(path).count() == 4 and spark.read.parquet(to).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sf.compact_chunks(spark, path, to)
    more = sf.save_chunks(spark.createDataFrame([("b", 0, 0, "b")], kind), to)
    assert rows(more) == [(None, 0, 0, "n"), ("a", 0, 0, "new"), ("b", 0, 0, "b")]


def test_split_by_value(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "k string, v int")
    parts = sf.split_by_value(df, "k", ["x", "y"], "loans_")
    assert list(parts) == ["loans_x", "loans_y"] and parts["loans_x"].count() == 2
    path = sf.scratch_path(spark, "split")
    sf.write_by_value(df, "k", path)
    assert rows(spark.read.parquet(path), "k", "v") == rows(df)


def test_filters_and_columns_reach_the_scan(spark):
    df = sf.read(spark, "orders", DATA).where(F.col("o_totalprice") > 1000).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
