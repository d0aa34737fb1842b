"""Queries over table checks, roll-ups and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

import stepframe as sf

from .registry import query

c = F.col


def actual_expected(t):
    actual = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").where("o_totalprice < 490000")
    price = F.when(c("o_custkey") < 20, c("o_totalprice") + 1).otherwise(c("o_totalprice"))
    expected = t.orders.select("o_orderkey", price.alias("o_totalprice"), "o_orderstatus")
    return actual, expected


ACTUAL = "(SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice < 490000)"
EXPECTED = """(SELECT o_orderkey, CASE WHEN o_custkey < 20 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
               o_orderstatus FROM orders)"""


@query(
    "parity_shape",
    f"""SELECT 'output_shape_match' AS name, 'fail' AS status,
               'Shape mismatch: got (' || (SELECT count(*) FROM {ACTUAL}) || ', 3), expected (' || (SELECT count(*) FROM {EXPECTED})
               || ', 3)' AS detail""",
)
def parity_shape(t):
    return sf.parity_shape(*actual_expected(t))


@query(
    "parity_values",
    f"""SELECT (SELECT count(*) FROM (FROM {ACTUAL} EXCEPT ALL FROM {EXPECTED})) AS extra,
               (SELECT count(*) FROM (FROM {EXPECTED} EXCEPT ALL FROM {ACTUAL})) AS missing""",
)
def parity_values(t):
    return sf.parity_values(*actual_expected(t))


def same_values(actual, expected, a, e):
    """SQL: the values of two columns are the same, copies counted."""
    return f"""(NOT EXISTS (SELECT {a} FROM {actual} EXCEPT ALL SELECT {e} FROM {expected})
                AND NOT EXISTS (SELECT {e} FROM {expected} EXCEPT ALL SELECT {a} FROM {actual}))"""


def column_row(actual, expected, a, e, equal, unequal="values differ"):
    """SQL: the row of two columns, by what their values say."""
    ok = same_values(actual, expected, a, e)
    return f"""SELECT '{a}' AS column_name, '{e}' AS expected_name,
                      CASE WHEN {ok} AND '{equal}' = 'same values' THEN 'pass' ELSE 'warning' END AS status,
                      CASE WHEN {ok} THEN '{equal}' ELSE '{unequal}' END AS detail"""


RENAMED = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal AS c_balance,
              CASE WHEN c_custkey % 100 = 7 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer)"""


@query(
    "parity_columns",
    " UNION ALL ".join(
        [column_row("customer", RENAMED, x, x, "same values") for x in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")]
        + [
            f"""SELECT 'c_acctbal', 'c_balance', 'warning', 'same values under another name'
                WHERE {same_values("customer", RENAMED, "c_acctbal", "c_balance")}""",
            "SELECT 'c_flag', NULL, 'warning', 'extra column'",
        ]
    ),
)
def parity_columns(t):
    actual = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", (c("c_custkey") % 3).alias("c_flag"))
    segment = F.when(c("c_custkey") % 100 == 7, "OTHER").otherwise(c("c_mktsegment"))
    expected = sf.rename(t.customer.withColumn("c_mktsegment", segment), {"c_acctbal": "c_balance"})
    return sf.column_parity(actual, expected.select("c_custkey", "c_name", "c_nationkey", "c_balance", "c_mktsegment"))


RETYPED = """(SELECT o_orderkey, o_orderstatus, o_totalprice::VARCHAR AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
              CASE WHEN o_orderkey % 500 = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END AS o_custkey FROM orders)"""


@query(
    "parity_dtypes",
    " UNION ALL ".join(
        [
            column_row("orders", RETYPED, "o_orderkey", "o_orderkey", "same values"),
            column_row("orders", RETYPED, "o_orderstatus", "o_orderstatus", "same values"),
            f"""SELECT 'o_totalprice', 'o_totalprice', 'warning', 'same values, double vs string'
                WHERE {same_values("orders", RETYPED, "o_totalprice", "o_totalprice::DOUBLE")}""",
            f"""SELECT 'o_orderdate', 'o_orderdate', 'warning', 'same values, date vs string'
                WHERE {same_values("(SELECT o_orderdate::DATE AS d FROM orders)", RETYPED, "d", "o_orderdate::DATE")}""",
            f"""SELECT 'o_custkey', 'o_custkey', 'warning', 'values differ, bigint vs string'
                WHERE EXISTS (SELECT 1 FROM {RETYPED} WHERE TRY_CAST(o_custkey AS DOUBLE) IS NULL)""",
        ]
    ),
)
def parity_dtypes(t):
    actual = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", c("o_orderdate").cast("date").alias("o_orderdate"), c("o_custkey").cast("bigint").alias("o_custkey"))
    texts = {"o_totalprice": c("o_totalprice").cast("string"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"), "o_custkey": F.when(c("o_orderkey") % 500 == 0, "n/a").otherwise(c("o_custkey").cast("string"))}
    return sf.column_parity(actual, actual.withColumns(texts))


FAMILIES = [("o_orderkey", "number"), ("o_orderstatus", "string"), ("o_totalprice", "number"), ("o_orderdate", "date"), ("o_custkey", "string")]


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, CASE WHEN count(*) = count(TRY_CAST({name}::VARCHAR AS DOUBLE)) THEN 'number'
                   WHEN count(*) = count(TRY_CAST({name}::VARCHAR AS TIMESTAMP)) THEN 'date' ELSE 'string' END AS family,
                   count(*) AS rows, count(*) - count({name}) AS nulls FROM {RETYPED}"""
        for name, _ in FAMILIES
    ),
)
def column_profile(t):
    texts = {"o_totalprice": c("o_totalprice").cast("string"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"), "o_custkey": F.when(c("o_orderkey") % 500 == 0, "n/a").otherwise(c("o_custkey").cast("string"))}
    retyped = t.orders.withColumns(texts).select(*[name for name, _ in FAMILIES])
    return sf.column_profiles(retyped).select("column_name", "family", "rows", "nulls")


@query(
    "parity_all",
    f"""SELECT 'output_shape_match' AS name, 'pass' AS status,
               'Shape matches: (' || (SELECT count(*) FROM orders) || ', 3)' AS detail UNION ALL
        SELECT 'column_names_match', 'pass', 'Column names match exactly.' UNION ALL
        SELECT 'dtypes_compatible', 'pass', 'Column types are compatible.' UNION ALL
        SELECT 'row_values_match', 'fail',
               'extra rows: ' || (SELECT count(*) FROM orders WHERE o_custkey < 20) || ', missing rows: '
               || (SELECT count(*) FROM orders WHERE o_custkey < 20)""",
)
def parity_all(t):
    _, expected = actual_expected(t)
    return sf.parity(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), expected)


@query(
    "required_names",
    """SELECT user_id, CASE WHEN miss = '' THEN 'pass' ELSE 'warning' END AS status, miss AS missing FROM
       (SELECT user_id, concat_ws(',', CASE WHEN NOT bool_or(event_type = 'purchase' AND value > 60) THEN 'purchase' END,
               CASE WHEN NOT bool_or(event_type = 'error' AND value > 60) THEN 'error' END) AS miss
        FROM events GROUP BY user_id)""",
)
def required_names(t):
    kind = F.when(c("value") > 60, c("event_type"))
    return sf.required_columns(t.events.select("user_id", kind.alias("kind")), "user_id", "kind", ["purchase", "error"])


@query(
    "required_in_text",
    """SELECT doc_id, 'input_vars_present' AS name, miss AS missing, CASE WHEN miss = '' THEN 'pass' ELSE 'warning' END AS status
       FROM (SELECT doc_id, concat_ws(',', CASE WHEN NOT (contains(text, 'the') OR contains(text, 'The')) THEN 'the' END,
                    CASE WHEN NOT contains(text, ' de ') THEN ' de ' END) AS miss FROM documents)""",
)
def required_in_text(t):
    names = {"the": ["The"], " de ": []}
    return sf.required(t.documents.select("doc_id", "text"), "text", names, "warning", "input_vars_present").drop("text")


def checks(t):
    """Five checks per document; unlabelled documents skip two of them."""
    docs = t.documents.join(t.labels, "doc_id", "left")
    length = F.when(c("n_chars") > 20000, "fail").when(c("n_chars") > 5000, "warning").otherwise("pass")
    rows = F.array(
        F.struct(F.lit("length").alias("name"), length.alias("status"),
                 F.concat(F.lit("n_chars "), c("n_chars")).alias("detail")),
        F.struct(F.lit("no_unresolved_macros").alias("name"),
                 F.when(c("text").contains("&"), "fail").otherwise("pass").alias("status"),
                 F.lit("ampersand").alias("detail")),
        F.struct(F.lit("uses_copy").alias("name"),
                 F.when(c("lang") == "en", "pass").otherwise("warning").alias("status"),
                 F.concat(F.lit("lang "), c("lang")).alias("detail")),
        F.struct(F.lit("quality").alias("name"),
                 F.when(c("quality") == 1, "pass").when(c("quality") == 0, "fail").otherwise("skipped").alias("status"),
                 F.lit("quality label").alias("detail")),
        F.struct(F.lit("toxic").alias("name"),
                 F.when(c("toxic") == 0, "pass").when(c("toxic") == 1, "warning").otherwise("skipped").alias("status"),
                 F.lit("toxic label").alias("detail")),
    )
    return docs.select(c("doc_id").alias("block_no"), F.inline(rows))


CHECKS = """(WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
  SELECT doc_id AS block_no, 'length' AS name, CASE WHEN n_chars > 20000 THEN 'fail' WHEN n_chars > 5000 THEN 'warning' ELSE 'pass' END AS status,
         'n_chars ' || n_chars AS detail FROM d UNION ALL
  SELECT doc_id, 'no_unresolved_macros', CASE WHEN contains(text, '&') THEN 'fail' ELSE 'pass' END, 'ampersand' FROM d UNION ALL
  SELECT doc_id, 'uses_copy', CASE WHEN lang = 'en' THEN 'pass' ELSE 'warning' END, 'lang ' || lang FROM d UNION ALL
  SELECT doc_id, 'quality', CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'skipped' END, 'quality label' FROM d UNION ALL
  SELECT doc_id, 'toxic', CASE toxic WHEN 0 THEN 'pass' WHEN 1 THEN 'warning' ELSE 'skipped' END, 'toxic label' FROM d)"""

ROLLED = f"""(SELECT block_no, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail'
      WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warning'
      WHEN count(*) FILTER (status <> 'skipped') = 0 THEN 'skipped' ELSE 'pass' END AS status,
    round(coalesce(count(*) FILTER (status = 'pass') / nullif(count(*) FILTER (status <> 'skipped'), 0)::DOUBLE, 0), 4)
      AS coverage_score FROM {CHECKS} GROUP BY block_no)"""


@query("severity_rollup", f"FROM {ROLLED}")
def severity_rollup(t):
    return sf.rollup(checks(t), "block_no")


@query(
    "scorecard",
    f"""SELECT count(*) AS total_blocks, count(*) FILTER (status = 'pass') AS passed,
               count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'warning') AS warnings,
               count(*) FILTER (status = 'skipped') AS skipped,
               round(coalesce(avg(coverage_score) FILTER (status <> 'skipped'), 0), 4) AS overall_score FROM {ROLLED}""",
)
def scorecard(t):
    return sf.scorecard(sf.rollup(checks(t), "block_no"))


@query(
    "line_coverage",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents),
       s AS (SELECT doc_id, raw, list_transform(raw, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS s FROM l),
       v AS (SELECT doc_id, list_transform(range(1, len(s) + 1), lambda i:
                CASE WHEN s[i] = '' OR starts_with(s[i], 'Le') OR regexp_matches(s[i], '^(?:The|Der)\s') THEN -1
                     WHEN contains(raw[i], 'qu') OR coalesce(starts_with(CASE WHEN s[i + 1] <> '' THEN s[i + 1]
                          WHEN s[i + 2] <> '' THEN s[i + 2] END, 'qu'), false) THEN 0 ELSE 1 END) AS v FROM s),
       n AS (SELECT doc_id, len(list_filter(v, lambda x: x >= 0))::BIGINT AS total,
                    len(list_filter(v, lambda x: x = 1))::BIGINT AS missing FROM v)
       SELECT doc_id, 'has_comments' AS name, total, missing,
              CASE WHEN total = 0 THEN 'skipped' WHEN missing = 0 THEN 'pass'
                   WHEN missing / total < 0.7 THEN 'warning' ELSE 'fail' END AS status FROM n""",
)
def line_coverage(t):
    return sf.line_coverage(t.documents.select("doc_id", "text"), "text", "qu", comment="Le", skip=r"^(?:The|Der)\s")


@query(
    "pattern_check",
    r"""SELECT doc_id, 'has_import' AS name, CASE WHEN regexp_matches(text, '(?m)^(?:The|Le) ') THEN 'pass' ELSE 'fail' END AS status
       FROM documents UNION ALL
       SELECT doc_id, 'no_eval_exec', CASE WHEN regexp_matches(text, 'que|the') THEN 'fail' ELSE 'pass' END FROM documents UNION ALL
       SELECT doc_id, 'no_inplace', CASE WHEN regexp_matches(text, '(?i)password\s*[=:]') THEN 'warning' ELSE 'pass' END FROM documents""",
)
def pattern_check(t):
    rules = [
        ("has_import", "(?m)^(?:The|Le) ", True, "fail"),
        ("no_eval_exec", "que|the", False, "fail"),
        ("no_inplace", r"(?i)password\s*[=:]", False, "warning"),
    ]
    return sf.pattern_check(t.documents.select("doc_id", "text"), "text", rules)


@query(
    "recommendations",
    f"""SELECT block_no, name, status, detail, CASE name WHEN 'no_unresolved_macros' THEN 'Run /macro-resolve before re-converting.'
               ELSE 'Add .copy() after boolean filters to avoid SettingWithCopyWarning.' END AS advice FROM {CHECKS}
        WHERE (name = 'no_unresolved_macros' AND status = 'fail') OR (name = 'uses_copy' AND status = 'warning')""",
)
def recommendations(t):
    return sf.recommendations(checks(t))


@query(
    "block_notes",
    f"""SELECT block_no, string_agg(detail, ' | ' ORDER BY status, name) AS notes FROM {CHECKS}
        WHERE status IN ('fail', 'warning') GROUP BY block_no""",
)
def block_notes(t):
    return sf.notes(checks(t), "block_no")


@query(
    "report_text",
    f"""WITH b AS (SELECT r.*, d.lang AS block_type, CASE WHEN d.doc_id % 5 <> 0 THEN d.source END AS output_dataset
                   FROM {ROLLED} r JOIN documents d ON block_no = doc_id),
        s AS (SELECT count(*) AS total, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'fail') AS f,
                     count(*) FILTER (status = 'warning') AS w, count(*) FILTER (status = 'skipped') AS k,
                     round(coalesce(avg(coverage_score) FILTER (status <> 'skipped'), 0), 4) AS o FROM b),
        c AS (FROM {CHECKS}),
        t AS (SELECT block_no, line, line_no FROM (
                SELECT doc_id AS block_no, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS line, generate_subscripts(l, 1)::BIGINT AS line_no
                FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE starts_with(line, 'In '))
        SELECT 1 AS part, 0::BIGINT AS block_no, i::BIGINT AS line_no, CASE i WHEN 0 THEN '# Data parity report'
            WHEN 1 THEN 'Overall score: ' || printf('%.2f', o) || ' — ' || CASE WHEN o >= 0.9 THEN 'Ready — safe to use'
                 WHEN o >= 0.7 THEN 'Review recommended' WHEN o >= 0.5 THEN 'Manual review required' ELSE 'Conversion failed' END
            WHEN 2 THEN '## Summary' WHEN 3 THEN '- Total blocks: ' || total
            ELSE '- Passed: ' || p || '  |  Warnings: ' || w || '  |  Failed: ' || f || '  |  Skipped: ' || k END AS line
        FROM s, range(5) r(i) UNION ALL
        SELECT 2, block_no, 0, '### [' || block_no || '] ' || upper(block_type) || ' → ' || coalesce(output_dataset, '?') || '  '
            || CASE status WHEN 'pass' THEN '✓ PASS' WHEN 'fail' THEN '✗ FAIL' WHEN 'warning' THEN '⚠ WARNING' ELSE '— SKIPPED' END
            || ' (' || printf('%.2f', coverage_score) || ')' FROM b UNION ALL
        SELECT 2, block_no, 1, 'All checks passed.' FROM b WHERE status = 'pass' UNION ALL
        SELECT 2, block_no, row_number() OVER (PARTITION BY block_no ORDER BY name, detail),
            '- ' || CASE status WHEN 'fail' THEN 'FAIL' ELSE 'WARN' END || ': ' || detail FROM c WHERE status IN ('fail', 'warning') UNION ALL
        SELECT 2, t.block_no, greatest(any_value(b.bad), (any_value(b.status) = 'pass')::BIGINT) + 1, '- INFO: ' || count(*) || ' TODO item(s) logged'
            FROM t JOIN (SELECT *, (SELECT count(*) FROM c WHERE c.block_no = b.block_no AND c.status IN ('fail', 'warning')) AS bad FROM b) b
            ON t.block_no = b.block_no GROUP BY t.block_no UNION ALL
        SELECT 3, 0, 0, '## TODO items (across all blocks)' UNION ALL
        SELECT 3, 0, k, k || '. ' || line FROM (SELECT line, row_number() OVER (ORDER BY min((block_no, line_no))) AS k FROM t GROUP BY line) UNION ALL
        SELECT 4, 0, 0, '## Recommendations' UNION ALL
        SELECT 4, c.block_no, 1, '- Block ' || c.block_no || ' (' || any_value(block_type) || ' → ' || coalesce(any_value(output_dataset), '?') || '): '
            || string_agg(CASE name WHEN 'no_unresolved_macros' THEN 'Run /macro-resolve before re-converting.'
               ELSE 'Add .copy() after boolean filters to avoid SettingWithCopyWarning.' END, ' | ' ORDER BY name) FROM c JOIN b ON c.block_no = b.block_no
        WHERE (name = 'no_unresolved_macros' AND c.status = 'fail') OR (name = 'uses_copy' AND c.status = 'warning') GROUP BY c.block_no""",
)
def report_text(t):
    rows = checks(t)
    names = t.documents.select(
        c("doc_id").alias("block_no"), c("lang").alias("block_type"),
        F.when(c("doc_id") % 5 != 0, c("source")).alias("output_dataset"),
    )
    todos = sf.marker_lines(t.documents.select(c("doc_id").alias("block_no"), "text"), "text", "In ")
    return sf.report(sf.rollup(rows, "block_no").join(names, "block_no"), rows, todos=todos)
