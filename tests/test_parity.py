import pytest
from conftest import rows
from pyspark.sql import functions as F

import stepframe as sf


def test_rollup(spark):
    data = [(1, s) for s in ("pass", "pass", "warning", "skipped")] + [(2, "skipped"), (3, "fail"), (3, "warning"), (4, "pass")]
    out = sf.rollup(spark.createDataFrame(data, "block_no int, status string"), "block_no")
    assert rows(out) == [(1, "warning", 0.6667), (2, "skipped", 0.0), (3, "fail", 0.0), (4, "pass", 1.0)]
    assert rows(sf.scorecard(out)) == [(4, 1, 1, 1, 1, 0.5556)]
    none = sf.scorecard(out.where("status = 'skipped'"))
    assert rows(none) == [(1, 0, 0, 0, 1, 0.0)]


def status(df):
    return {r.name: r.status for r in df.collect()}


def test_parity(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, s string")
    assert status(sf.parity(a, a)) == dict.fromkeys(
        ("output_shape_match", "column_names_match", "dtypes_compatible", "row_values_match"), "pass"
    )
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, s string")
    assert status(sf.parity(a, b))["row_values_match"] == "fail"
    assert rows(sf.parity_values(a, b)) == [(1, 1)]
    c = spark.createDataFrame([(1, 1)], "k string, t int")
    got = {r.name: (r.status, r.detail) for r in sf.parity(a, c).collect()}
    assert got["output_shape_match"] == ("fail", "Shape mismatch: got (3, 2), expected (1, 2)")
    assert got["column_names_match"] == ("warning", "Column mismatch — extra: ['s'], missing: ['t']")
    assert got["dtypes_compatible"][0] == "warning" and got["row_values_match"][0] == "skipped"
    assert set(status(sf.parity(a, None)).values()) == {"skipped"}


def test_column_profiles_see_values(spark):
    data = [(1, "1.0", "2024-01-31", "x", 1.5, None), (2, " 2", "2024-02-01 00:00:00", None, -0.0, None), (3, "3e0", None, "7", 0.0, None)]
    df = spark.createDataFrame(data, "n int, t string, d string, s string, f double, e string")
    got = {r.column_name: r for r in sf.column_profiles(df).collect()}
    assert {k: (r.family, r.rows, r.nulls) for k, r in got.items()} == {
        "n": ("number", 3, 0), "t": ("number", 3, 0), "d": ("date", 3, 1), "s": ("string", 3, 1), "f": ("number", 3, 0), "e": ("string", 3, 3)
    }
    assert got["n"].values_digest == got["t"].values_digest and got["n"].digest != got["t"].digest
    again = {r.column_name: r.digest for r in sf.column_profiles(df.orderBy("n", ascending=False).repartition(3)).collect()}
    assert again == {k: r.digest for k, r in got.items()}
    assert {(r.rows, r.nulls, r.digest) for r in sf.column_profiles(df.limit(0)).collect()} == {(0, 0, None)}


def test_column_parity(spark):
    a = spark.createDataFrame([(1, "x", 2.0, "p", "2024-01-31"), (2, "y", 3.0, "p", None)], "k int, s string, v double, `odd name` string, d string")
    e = a.selectExpr("k", "s AS t", "cast(v AS string) AS v", "`odd name`", "cast(d AS date) AS d", "k * 0 AS zero")
    got = {(r.column_name, r.expected_name): (r.status, r.detail) for r in sf.column_parity(a, e).collect()}
    assert got == {
        ("k", "k"): ("pass", "same values"),
        ("s", "t"): ("warning", "same values under another name"),
        ("v", "v"): ("warning", "same values, double vs string"),
        ("odd name", "odd name"): ("pass", "same values"),
        ("d", "d"): ("warning", "same values, string vs date"),
        (None, "zero"): ("warning", "missing column"),
    }
    changed = a.withColumn("s", F.when(F.col("k") == 1, "y").otherwise("y"))
    assert {r.column_name: r.detail for r in sf.column_parity(a, changed).collect()}["s"] == "values differ"
    twins = a.selectExpr("k AS a", "k AS b")
    assert rows(sf.column_parity(twins, a.selectExpr("k AS y", "k AS x"))) == [("a", "x", "warning", "same values under another name"), ("b", "y", "warning", "same values under another name")]


def test_required(spark):
    df = spark.createDataFrame([(1, "uses out_df"), (2, "nothing")], "id int, code string")
    out = sf.required(df, "code", {"out": ["out_df"]}, "fail", "output_var_present")
    assert rows(out, "id", "status", "missing") == [(1, "pass", ""), (2, "fail", "out")]
    assert rows(sf.required(df, "code", {}, "fail", "x"), "status") == [("skipped",), ("skipped",)]
    kv = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, v string")
    assert rows(sf.required_columns(kv, "k", "v", ["a", "b"])) == [(1, "pass", ""), (2, "warning", "b")]


@pytest.mark.parametrize(
    "code, want",
    [
        ("import pandas\nx = 1  # REF: a\ny = 2\n\n# REF: b", (2, 0, "pass")),
        ("x = 1\ny = 2\nz = 3  # REF: c", (3, 2, "warning")),
        ("x = 1\n\n\n# REF: too far", (1, 1, "fail")),
        ("x = 1\ny = 2  # other\n# REF: next", (2, 1, "warning")),
        ("# only comments\nfrom a import b", (0, 0, "skipped")),
    ],
)
def test_line_coverage(spark, code, want):
    out = sf.line_coverage(spark.createDataFrame([(1, code)], "id int, code string"), "code", "# REF:")
    assert rows(out, "total", "missing", "status") == [want]


def test_notes_and_report(spark):
    checks = spark.createDataFrame(
        [(1, "has_import", "fail", "f"), (1, "a", "warning", "w"), (1, "b", "fail", "g"), (2, "a", "pass", "p")],
        "block_no int, name string, status string, detail string",
    )
    assert rows(sf.notes(checks, "block_no")) == [(1, "g | f | w")]
    blocks = sf.rollup(checks, "block_no").join(
        spark.createDataFrame([(1, "data_step", "out"), (2, "proc_sql", None)], "block_no int, block_type string, output_dataset string"),
        "block_no",
    )
    text = [r.line for r in sf.report(blocks, checks).orderBy("part", "block_no", "line_no").collect()]
    assert text == [
        "# Data parity report", "Overall score: 0.50 — Manual review required", "## Summary", "- Total blocks: 2",
        "- Passed: 1  |  Warnings: 0  |  Failed: 1  |  Skipped: 0",
        "### [1] DATA_STEP → out  ✗ FAIL (0.00)", "- WARN: w", "- FAIL: g", "- FAIL: f",
        "### [2] PROC_SQL → ?  ✓ PASS (1.00)", "All checks passed.",
        "## TODO items (across all blocks)", "(none)",
        "## Recommendations", "- Block 1 (data_step → out): Re-run /convert — output missing import statement.",
    ]
    todos = spark.createDataFrame([(1, 4, "# TODO: b"), (2, 1, "# TODO: a"), (2, 9, "# TODO: b")], "block_no int, line_no bigint, line string")
    text = [r.line for r in sf.report(blocks, checks.where("block_no = 2"), todos=todos).orderBy("part", "block_no", "line_no").collect()]
    assert text[-6:] == [
        "- INFO: 2 TODO item(s) logged", "## TODO items (across all blocks)", "1. # TODO: b", "2. # TODO: a",
        "## Recommendations", "No specific recommendations — review any warnings above.",
    ]


def test_pattern_check(spark):
    df = spark.createDataFrame([(1, "import x\neval(1)"), (2, "pass")], "id int, code string")
    rules = [("has_import", "(?m)^import", True, "fail"), ("no_eval_exec", r"eval\(|exec\(", False, "fail")]
    assert rows(sf.pattern_check(df, "code", rules)) == [
        (1, "has_import", "pass"), (1, "no_eval_exec", "fail"), (2, "has_import", "fail"), (2, "no_eval_exec", "pass")
    ]
