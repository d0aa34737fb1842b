"""Checks of one table against another, check roll-ups, scores and the report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logic import BANDS_LONG, BELOW_BANDS_LONG, band
from .chunking import line_marks
from .keys import same_keys
from .ordered import row_index, row_number

STATUSES = ("pass", "fail", "warning", "skipped")


def _family(dt: T.DataType) -> str:
    if isinstance(dt, T.NumericType):
        return "number"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return dt.typeName()


def parity_shape(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One check row: equal numbers of rows and columns."""
    ca, ce = len(actual.columns), len(expected.columns)
    counts = actual.agg(F.count(F.lit(1)).alias("rows_got")).withColumn(
        "rows_expected", expected.agg(F.count(F.lit(1))).scalar()
    )
    same = (F.col("rows_got") == F.col("rows_expected")) & F.lit(ca == ce)
    got = F.concat(F.lit("("), F.col("rows_got").cast("string"), F.lit(f", {ca})"))
    want = F.concat(F.lit("("), F.col("rows_expected").cast("string"), F.lit(f", {ce})"))
    return counts.select(
        F.lit("output_shape_match").alias("name"),
        F.when(same, "pass").otherwise("fail").alias("status"),
        F.when(same, F.concat(F.lit("Shape matches: "), got))
        .otherwise(F.concat(F.lit("Shape mismatch: got "), got, F.lit(", expected "), want))
        .alias("detail"),
    )


def _one(df: DataFrame, name: str, status: str, detail: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(name, status, detail)], "name string, status string, detail string")


def parity_columns(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One check row: the same set of column names; a difference is a warning."""
    got, want = set(actual.columns), set(expected.columns)
    if got == want:
        return _one(actual, "column_names_match", "pass", "Column names match exactly.")
    detail = f"Column mismatch — extra: {sorted(got - want)}, missing: {sorted(want - got)}"
    return _one(actual, "column_names_match", "warning", detail)


def parity_dtypes(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One check row: shared columns have types of the same family (number, date, text, ...)."""
    want = {f.name: f.dataType for f in expected.schema.fields}
    bad = [
        f"{f.name}: {f.dataType.simpleString()} vs {want[f.name].simpleString()}"
        for f in actual.schema.fields
        if f.name in want and _family(f.dataType) != _family(want[f.name])
    ]
    if not bad:
        return _one(actual, "dtypes_compatible", "pass", "Column types are compatible.")
    return _one(actual, "dtypes_compatible", "warning", f"Incompatible types: {bad}")


# Texts that count as numbers and as dates.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def _digest(value: Column) -> Column:
    """Sum of hashes: the same for the same values in any order, copies counted; missing values are left out."""
    return F.sum(F.when(value.isNotNull(), F.xxhash64(value)).cast("decimal(20,0)")).cast("decimal(38,0)")


def column_profiles(df: DataFrame) -> DataFrame:
    """One row per column from all its values: (column_name, declared, family, rows, nulls, digest, values_digest).

    ``family`` is what the values are: a text column whose values all read as numbers (or dates) is of that family.
    ``digest`` stands for the values as they are typed, ``values_digest`` for the numbers, moments or texts that they mean,
    so that it survives a change of type. One aggregate over the table; nothing but its single row moves on.
    """
    parts, profiles = [], []
    for i, f in enumerate(df.schema.fields):
        col, kind = F.col(f"`{f.name}`"), _family(f.dataType)
        typed = F.to_json(F.struct(col)) if "map<" in f.dataType.simpleString() else col
        number = moment = F.lit(None)
        if kind == "number":
            number = col.cast("double") + F.lit(0.0)  # one zero
        elif kind == "date":
            moment = col.cast("timestamp_ntz").cast("string")
        elif kind == "string":
            number = F.when(col.rlike(_NUMBER), F.trim(col).try_cast("double") + F.lit(0.0))
            moment = F.when(col.rlike(_DATE), col.try_cast("timestamp_ntz").cast("string"))
        names = {n: f"__{n}{i}" for n in ("n", "numbers", "moments", "digest", "as_number", "as_moment")}
        parts += [
            F.count(col).alias(names["n"]),
            F.count(number).alias(names["numbers"]),
            F.count(moment).alias(names["moments"]),
            _digest(typed).alias(names["digest"]),
            _digest(number.cast("double")).alias(names["as_number"]),
            _digest(moment.cast("string")).alias(names["as_moment"]),
        ]
        some = F.col(names["n"]) > 0
        family = F.lit(kind)
        if kind == "string":
            family = F.when(some & (F.col(names["numbers"]) == F.col(names["n"])), "number").when(some & (F.col(names["moments"]) == F.col(names["n"])), "date").otherwise("string")
        profiles.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("declared"),
                family.alias("family"),
                F.col("__rows").alias("rows"),
                (F.col("__rows") - F.col(names["n"])).alias("nulls"),
                F.col(names["digest"]).alias("digest"),
                F.when(family == "number", F.col(names["as_number"])).when(family == "date", F.col(names["as_moment"])).otherwise(F.col(names["digest"])).alias("values_digest"),
            )
        )
    return df.agg(F.count(F.lit(1)).alias("__rows"), *parts).select(F.inline(F.array(*profiles)))


def column_parity(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per column of either table, judged by all its values: (column_name, expected_name, status, detail).

    Columns of one name pass when their values are the same, in any order. A column under another name is found by its
    values, and so is one of another type: both are warnings, as are different values, extra and missing columns.
    Both profiles have a row per column, so everything after the two aggregates is small.
    """
    a, e = column_profiles(actual).alias("a"), column_profiles(expected).alias("e")
    by_name = a.join(e, F.col("a.column_name") == F.col("e.column_name"), "full")
    a_only = by_name.where("e.column_name IS NULL").select("a.*")
    e_only = by_name.where("a.column_name IS NULL").select("e.*")
    look = ["family", "rows", "nulls", "values_digest"]
    place = Window.partitionBy(*look).orderBy("column_name")  # equal columns are paired in the order of their names
    x, y = (t.withColumn("__place", F.row_number().over(place)).alias(n) for t, n in ((a_only, "x"), (e_only, "y")))
    on = same_keys((F.col(f"x.{c}"), F.col(f"y.{c}")) for c in [*look, "__place"])
    moved = x.join(y, on, "full").select(
        F.col("x.column_name").alias("column_name"),
        F.col("y.column_name").alias("expected_name"),
        F.lit("warning").alias("status"),
        F.when(F.col("y.column_name").isNull(), "extra column").when(F.col("x.column_name").isNull(), "missing column").otherwise("same values under another name").alias("detail"),
    )
    same_type = F.col("a.declared") == F.col("e.declared")
    counts = (F.col("a.rows") == F.col("e.rows")) & (F.col("a.nulls") == F.col("e.nulls"))
    equal = counts & F.when(same_type, F.col("a.digest").eqNullSafe(F.col("e.digest"))).otherwise((F.col("a.family") == F.col("e.family")) & F.col("a.values_digest").eqNullSafe(F.col("e.values_digest")))
    types = F.concat(F.col("a.declared"), F.lit(" vs "), F.col("e.declared"))
    named = by_name.where("a.column_name IS NOT NULL AND e.column_name IS NOT NULL").select(
        F.col("a.column_name").alias("column_name"),
        F.col("e.column_name").alias("expected_name"),
        F.when(equal & same_type, "pass").otherwise("warning").alias("status"),
        F.when(equal & same_type, F.lit("same values"))
        .when(equal, F.concat(F.lit("same values, "), types))
        .when(same_type, F.lit("values differ"))
        .otherwise(F.concat(F.lit("values differ, "), types))
        .alias("detail"),
    )
    return named.unionByName(moved)


def parity_values(actual: DataFrame, expected: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row (extra, missing): rows only in ``actual`` / only in ``expected``, copies counted.

    One partial aggregate over the signed union; equal rows cancel out before the shuffle.
    """
    cols = list(cols or actual.columns)
    signed = actual.select(*cols, F.lit(1).alias("__w")).unionByName(
        expected.select(*cols, F.lit(-1).alias("__w"))
    )
    diff = signed.groupBy(*cols).agg(F.sum("__w").alias("d"))
    return diff.agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).cast("bigint").alias("extra"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).cast("bigint").alias("missing"),
    )


def parity(actual: DataFrame, expected: DataFrame | None) -> DataFrame:
    """All table checks as rows (name, status, detail); all skipped without an expected table."""
    if expected is None:
        rows = [
            (n, "skipped", "No expected DataFrame provided.")
            for n in ("output_shape_match", "column_names_match", "dtypes_compatible", "row_values_match")
        ]
        return actual.sparkSession.createDataFrame(rows, "name string, status string, detail string")
    checks = parity_shape(actual, expected).unionByName(parity_columns(actual, expected))
    checks = checks.unionByName(parity_dtypes(actual, expected))
    if set(actual.columns) != set(expected.columns):
        return checks.unionByName(
            _one(actual, "row_values_match", "skipped", "Columns differ — values not compared.")
        )
    v = parity_values(actual, expected)
    same = (F.col("extra") == 0) & (F.col("missing") == 0)
    values = v.select(
        F.lit("row_values_match").alias("name"),
        F.when(same, "pass").otherwise("fail").alias("status"),
        F.concat(
            F.lit("extra rows: "), F.col("extra").cast("string"),
            F.lit(", missing rows: "), F.col("missing").cast("string"),
        ).alias("detail"),
    )
    return checks.unionByName(values)


def required(df: DataFrame, text: str, names: Mapping[str, Sequence[str]], level: str, name: str) -> DataFrame:
    """Check per text that a name occurs, in any of its accepted spellings.

    Adds ``name``, ``status`` (``level`` when some are missing) and ``missing`` (comma list).
    """
    if not names:
        return df.withColumns(
            {"name": F.lit(name), "status": F.lit("skipped"), "missing": F.lit("")}
        )
    parts = []
    for n, spellings in names.items():
        hit = F.lit(False)
        for s in [n, *spellings]:
            hit = hit | F.contains(F.col(text), F.lit(s))
        parts.append(F.when(~F.coalesce(hit, F.lit(False)), n))
    absent = F.array_join(F.array_compact(F.array(*parts)), ",")
    out = df.withColumns({"name": F.lit(name), "missing": absent})
    return out.withColumn("status", F.when(F.col("missing") == "", "pass").otherwise(level))


def required_columns(df: DataFrame, key: str, value: str, names: Sequence[str], level: str = "warning") -> DataFrame:
    """Check per key that all required values occur in the rows of the key.

    One partial aggregate with a bit per required name; the rows of a key are never gathered.
    """
    have = df.groupBy(key).agg(
        *[F.max(F.when(F.col(value) == n, 1).otherwise(0)).alias(f"__h{i}") for i, n in enumerate(names)]
    )
    absent = F.array_compact(F.array(*[F.when(F.col(f"__h{i}") == 0, n) for i, n in enumerate(names)]))
    return have.select(
        key,
        F.when(F.size(absent) == 0, "pass").otherwise(level).alias("status"),
        F.array_join(absent, ",").alias("missing"),
    )


def pattern_check(df: DataFrame, text: str, rules: Sequence[tuple[str, str, bool, str]]) -> DataFrame:
    """Check rows per text for rules (check name, pattern, must occur, status when violated)."""
    checks = []
    for name, pattern, must, level in rules:
        found = F.coalesce(F.col(text).rlike(pattern), F.lit(False))
        ok = found if must else ~found
        checks.append(F.struct(F.lit(name).alias("name"), F.when(ok, "pass").otherwise(level).alias("status")))
    return df.select(*[c for c in df.columns if c != text], F.inline(F.array(*checks)))


# Fixed value: share of unmarked lines from which the check fails instead of warning.
MISSING_LIMIT = 0.7


def line_coverage(
    df: DataFrame,
    text: str,
    mark: str,
    comment: str = "#",
    skip: str = r"^(?:import|from)\s",
    name: str = "has_comments",
) -> DataFrame:
    """Share of substantive lines without a mark: none → pass, below 0.7 → warning, else fail."""
    out = line_marks(df, text, comment, skip, mark)
    total, missing = F.col("total"), F.col("missing")
    status = (
        F.when(total == 0, "skipped")
        .when(missing == 0, "pass")
        .when(missing / total < MISSING_LIMIT, "warning")
        .otherwise("fail")
    )
    return out.select(
        *[c for c in df.columns if c != text],
        F.lit(name).alias("name"),
        "total",
        "missing",
        status.alias("status"),
    )


def rollup(checks: DataFrame, by) -> DataFrame:
    """Status and coverage per block.

    Any fail → fail, else any warning → warning, else all skipped → skipped, else pass. Coverage is
    passed / not skipped, 0.0 when all are skipped, rounded to 4 places.
    """
    by = [by] if isinstance(by, str) else list(by)
    n = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    total = F.count(F.lit(1))
    status = (
        F.when(n["fail"] > 0, "fail")
        .when(n["warning"] > 0, "warning")
        .when(n["skipped"] == total, "skipped")
        .otherwise("pass")
    )
    share = F.try_divide(n["pass"].cast("double"), (total - n["skipped"]).cast("double"))
    return checks.groupBy(*by).agg(
        status.alias("status"), F.round(F.coalesce(share, F.lit(0.0)), 4).alias("coverage_score")
    )


def scorecard(blocks: DataFrame) -> DataFrame:
    """One row: blocks per status and the mean coverage of those not skipped."""
    s = F.col("status")
    mean = F.avg(F.when(s != "skipped", F.col("coverage_score")))
    return blocks.agg(
        F.count(F.lit(1)).alias("total_blocks"),
        F.count_if(s == "pass").alias("passed"),
        F.count_if(s == "fail").alias("failed"),
        F.count_if(s == "warning").alias("warnings"),
        F.count_if(s == "skipped").alias("skipped"),
        F.round(F.coalesce(mean, F.lit(0.0)), 4).alias("overall_score"),
    )


# Advice per (check, status).
ADVICE = (
    ("no_unresolved_macros", "fail", "Run /macro-resolve before re-converting."),
    ("output_var_present", "fail", "Re-run /convert — output variable name mismatch."),
    ("has_import", "fail", "Re-run /convert — output missing import statement."),
    ("uses_copy", "warning", "Add .copy() after boolean filters to avoid SettingWithCopyWarning."),
)


def recommendations(checks: DataFrame, advice: Sequence[tuple[str, str, str]] = ADVICE) -> DataFrame:
    """Checks that have advice, with its text. The advice table is a short constant."""
    text = F.lit(None).cast("string")
    for name, status, value in reversed(advice):
        text = F.when((F.col("name") == name) & (F.col("status") == status), value).otherwise(text)
    return checks.withColumn("advice", text).where(F.col("advice").isNotNull())


# Status words in the report.
ICONS = {"pass": "✓ PASS", "fail": "✗ FAIL", "warning": "⚠ WARNING", "skipped": "— SKIPPED"}


def _icon(status: Column) -> Column:
    expr = F.upper(status)
    for s, text in ICONS.items():
        expr = F.when(status == s, text).otherwise(expr)
    return expr


def notes(checks: DataFrame, by) -> DataFrame:
    """Failed, then warned details of a block joined by `` | ``.

    The notes of a block are one text, from its fixed list of checks; ``report`` has a row per finding.
    """
    by = [by] if isinstance(by, str) else list(by)
    severity = F.when(F.col("status") == "fail", 0).when(F.col("status") == "warning", 1)
    bad = checks.withColumn("__s", severity).where(F.col("__s").isNotNull())
    order = F.struct("__s", "name", "detail")
    found = F.array_sort(F.collect_list(order))
    return bad.groupBy(*by).agg(F.array_join(F.transform(found, lambda x: x.getField("detail")), " | ").alias("notes"))


def report(
    blocks: DataFrame,
    checks: DataFrame,
    block_no: str = "block_no",
    kind: str = "block_type",
    dataset: str = "output_dataset",
    title: str = "# Data parity report",
    todos: DataFrame | None = None,
) -> DataFrame:
    """The report as lines (part, block_no, line_no, line); sort by the first three to print it.

    Part 1 is the summary, part 2 has a heading per block followed by one line per finding and the
    number of its TODO items, part 3 lists the different TODO items in the order they first occur,
    part 4 the recommendations per block. ``todos`` are marked lines (block_no, line_no, line). Lines
    stay rows, so a report over very many blocks is written in parallel like any other table.
    """
    card = scorecard(blocks)
    score_text = F.format_string("%.2f", F.col("overall_score"))
    head = [
        F.lit(title),
        F.concat(F.lit("Overall score: "), score_text, F.lit(" — "), band(F.col("overall_score"), BANDS_LONG, BELOW_BANDS_LONG)),
        F.lit("## Summary"),
        F.concat(F.lit("- Total blocks: "), F.col("total_blocks").cast("string")),
        F.concat(
            F.lit("- Passed: "), F.col("passed").cast("string"),
            F.lit("  |  Warnings: "), F.col("warnings").cast("string"),
            F.lit("  |  Failed: "), F.col("failed").cast("string"),
            F.lit("  |  Skipped: "), F.col("skipped").cast("string"),
        ),
    ]
    top = card.select(F.posexplode(F.array(*head)).alias("line_no", "line")).select(
        F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("block_no"),
        F.col("line_no").cast("bigint").alias("line_no"), "line",
    )
    number = F.col(block_no).cast("bigint").alias("block_no")
    headings = blocks.select(
        F.lit(2).alias("part"), number, F.lit(0).cast("bigint").alias("line_no"),
        F.concat(
            F.lit("### ["), F.col(block_no).cast("string"), F.lit("] "), F.upper(kind), F.lit(" → "),
            F.coalesce(F.col(dataset), F.lit("?")), F.lit("  "), _icon(F.col("status")),
            F.lit(" ("), F.format_string("%.2f", F.col("coverage_score")), F.lit(")"),
        ).alias("line"),
    )
    passed = blocks.where(F.col("status") == "pass").select(
        F.lit(2).alias("part"), number, F.lit(1).cast("bigint").alias("line_no"),
        F.lit("All checks passed.").alias("line"),
    )
    level = F.when(F.col("status") == "fail", "FAIL").when(F.col("status") == "warning", "WARN")
    bad = checks.withColumn("__level", level).where(F.col("__level").isNotNull())
    numbered = row_number(
        bad.select(block_no, "name", "detail", "__level"), block_no, ["name", "detail"], "line_no"
    )
    findings = numbered.select(
        F.lit(2).alias("part"), number, "line_no",
        F.concat(F.lit("- "), F.col("__level"), F.lit(": "), F.col("detail")).alias("line"),
    )
    out = top.unionByName(headings).unionByName(passed).unionByName(findings)
    section = lambda part, line_no, line, df=card: df.select(
        F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("block_no"), F.lit(line_no).cast("bigint").alias("line_no"), F.lit(line).alias("line")
    )
    out = out.unionByName(section(3, 0, "## TODO items (across all blocks)"))
    if todos is None:
        out = out.unionByName(section(3, 1, "(none)"))
    else:
        many = todos.groupBy(block_no).agg(F.count(F.lit(1)).alias("__todos"))
        above = bad.groupBy(block_no).agg(F.count(F.lit(1)).cast("bigint").alias("__above"))
        counted = blocks.select(block_no, "status").join(many, block_no).join(above, block_no, "left")
        after = F.greatest(F.coalesce("__above", F.lit(0)), (F.col("status") == "pass").cast("bigint")) + 1
        items = counted.select(
            F.lit(2).alias("part"), number, after.alias("line_no"),
            F.concat(F.lit("- INFO: "), F.col("__todos").cast("string"), F.lit(" TODO item(s) logged")).alias("line"),
        )
        first = todos.groupBy("line").agg(F.min(F.struct(F.col(block_no).alias("b"), F.col("line_no").alias("n"))).alias("__at"))
        listed = row_index(first.select("line", F.col("__at.b").alias("__b"), F.col("__at.n").alias("__n")), ["__b", "__n", "line"], "line_no", ties=False)
        listed = listed.select(
            F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("block_no"), "line_no",
            F.concat(F.col("line_no").cast("string"), F.lit(". "), F.col("line")).alias("line"),
        )
        none = section(3, 1, "(none)", todos.agg(F.count(F.lit(1)).alias("n")).where("n = 0"))
        out = out.unionByName(items).unionByName(listed).unionByName(none)
    each = recommendations(checks).groupBy(block_no).agg(F.array_sort(F.collect_list(F.struct("name", "advice"))).alias("__advice"))
    tips = each.join(blocks.select(block_no, kind, dataset), block_no).select(
        F.lit(4).alias("part"), number, F.lit(1).cast("bigint").alias("line_no"),
        F.concat(
            F.lit("- Block "), F.col(block_no).cast("string"), F.lit(" ("), F.col(kind), F.lit(" → "), F.coalesce(F.col(dataset), F.lit("?")), F.lit("): "),
            F.array_join(F.transform("__advice", lambda x: x["advice"]), " | "),
        ).alias("line"),
    )
    quiet = section(4, 1, "No specific recommendations — review any warnings above.", recommendations(checks).agg(F.count(F.lit(1)).alias("n")).where("n = 0"))
    return out.unionByName(section(4, 0, "## Recommendations")).unionByName(tips).unionByName(quiet)
