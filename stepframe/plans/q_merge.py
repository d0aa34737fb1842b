"""Queries over keyed merges, joins, stacking and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

import stepframe as sf

from .registry import query

c = F.col


def year_book(t, year: int):
    """One row per customer of a year; some customers have a missing key."""
    key = F.nullif(c("o_custkey"), F.lit(7)).alias("k")
    picked = t.orders.where(F.year("o_orderdate") == year).select(key, "o_totalprice", "o_orderkey")
    return picked.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def book_sql(year: int) -> str:
    return f"""(SELECT nullif(o_custkey, 7) AS k, count(*) AS n,
                       round(sum(o_totalprice), 2) AS total
                FROM orders WHERE year(o_orderdate) = {year} GROUP BY ALL)"""


CURR, PREV, OLD = book_sql(2001), book_sql(2000), book_sql(1999)


def two_books(t):
    curr = year_book(t, 2001).withColumnRenamed("n", "n_curr").drop("total")
    prev = year_book(t, 2000).withColumnRenamed("total", "total_prev").drop("n")
    return [curr, prev]


def _merge_sql(join: str, where: str = "") -> str:
    return f"""SELECT coalesce(a.k, b.k) AS k, a.n AS n_curr, b.total AS total_prev
               FROM (SELECT *, 1 AS a FROM {CURR}) a {join} JOIN (SELECT *, 1 AS b FROM {PREV}) b
               ON a.k IS NOT DISTINCT FROM b.k {where}"""


for _name, _keep, _sql in [
    ("merge_outer", "all", _merge_sql("FULL")),
    ("merge_inner", "both", _merge_sql("INNER")),
    ("merge_left", "left", _merge_sql("LEFT")),
    ("merge_right", "right", _merge_sql("RIGHT")),
    ("merge_left_only", "left_only", _merge_sql("LEFT", "WHERE b.b IS NULL")),
    ("merge_right_only", "right_only", _merge_sql("RIGHT", "WHERE a.a IS NULL")),
]:
    query(_name, _sql)(lambda t, keep=_keep: sf.merge(two_books(t), "k", keep=keep))


@query(
    "merge_in_flags",
    f"""SELECT coalesce(a.k, b.k) AS k, a.total, b.total AS prev_total,
               CASE WHEN b.b IS NULL THEN 'NEW' WHEN a.a IS NULL THEN 'GONE' ELSE 'EXISTING' END AS change_flag,
               CASE WHEN a.a = 1 AND b.b = 1 THEN round(a.total - b.total, 2) END AS balance_change,
               coalesce(a.a, 0) AS curr, coalesce(b.b, 0) AS prev
        FROM (SELECT *, 1 AS a FROM {CURR}) a FULL JOIN (SELECT *, 1 AS b FROM {PREV}) b
        ON a.k IS NOT DISTINCT FROM b.k""",
)
def merge_in_flags(t):
    curr = year_book(t, 2001).drop("n")
    prev = sf.rename(year_book(t, 2000).drop("n"), {"total": "prev_total"})
    both = sf.merge([curr, prev], "k", flags=["curr", "prev"])
    return sf.assign_when(
        both,
        [
            (c("prev") == 0, {"change_flag": F.lit("NEW")}),
            (c("curr") == 0, {"change_flag": F.lit("GONE")}),
        ],
        else_={
            "change_flag": F.lit("EXISTING"),
            "balance_change": F.round(c("total") - c("prev_total"), 2),
        },
    )


@query(
    "merge_overlap",
    f"""SELECT coalesce(a.k, b.k) AS k, a.n AS n_curr,
               CASE WHEN b.b = 1 THEN b.total ELSE a.total END AS total
        FROM (SELECT *, 1 AS a FROM {CURR}) a
        FULL JOIN (SELECT k, CASE WHEN n > 1 THEN total END AS total, 1 AS b FROM {PREV}) b
        ON a.k IS NOT DISTINCT FROM b.k""",
)
def merge_overlap(t):
    curr = year_book(t, 2001).withColumnRenamed("n", "n_curr")
    prev = year_book(t, 2000).select("k", F.when(c("n") > 1, c("total")).alias("total"))
    return sf.merge([curr, prev], "k")


@query(
    "merge_rename",
    f"""SELECT coalesce(a.k, b.k) AS custkey, a.n, a.total, b.n AS n_before, b.total AS total_before
        FROM {CURR} a FULL JOIN {PREV} b ON a.k IS NOT DISTINCT FROM b.k""",
)
def merge_rename(t):
    curr = sf.rename(year_book(t, 2001), {"k": "custkey"})
    prev = sf.rename(year_book(t, 2000), {"k": "custkey", "n": "n_before", "total": "total_before"})
    return sf.merge([curr, prev], "custkey")


@query(
    "merge_one_to_many",
    """SELECT coalesce(c_custkey, o_custkey) AS custkey, c_name, c_mktsegment, o_orderkey, o_totalprice
       FROM customer FULL JOIN (SELECT * REPLACE (o_custkey + o_orderkey % 3 * 100000000 AS o_custkey) FROM orders)
       ON c_custkey = o_custkey""",
)
def merge_one_to_many(t):
    one = t.customer.select(c("c_custkey").alias("custkey"), "c_name", "c_mktsegment")
    many = t.orders.select(
        (c("o_custkey") + c("o_orderkey") % 3 * 100000000).alias("custkey"), "o_orderkey", "o_totalprice"
    )
    return sf.merge([one, many], "custkey")


@query(
    "merge_three",
    f"""SELECT k, max(n1) AS n_2001, max(n2) AS n_2000, max(n3) AS n_1999,
               max(CASE WHEN n1 IS NULL THEN 0 ELSE 1 END) AS in1, max(CASE WHEN n2 IS NULL THEN 0 ELSE 1 END) AS in2,
               max(CASE WHEN n3 IS NULL THEN 0 ELSE 1 END) AS in3
        FROM (SELECT k, n AS n1, NULL AS n2, NULL AS n3 FROM {CURR} UNION ALL
              SELECT k, NULL, n, NULL FROM {PREV} UNION ALL SELECT k, NULL, NULL, n FROM {OLD}) GROUP BY k""",
)
def merge_three(t):
    books = [year_book(t, y).select("k", c("n").alias(f"n_{y}")) for y in (2001, 2000, 1999)]
    return sf.merge(books, "k", flags=["in1", "in2", "in3"])


@query(
    "merge_condition",
    f"""SELECT k, max(n1) AS n_2001, max(n2) AS n_2000, max(n3) AS n_1999
        FROM (SELECT k, n AS n1, NULL AS n2, NULL AS n3 FROM {CURR} UNION ALL
              SELECT k, NULL, n, NULL FROM {PREV} UNION ALL SELECT k, NULL, NULL, n FROM {OLD}) GROUP BY k
        HAVING max(n1) IS NOT NULL AND (max(n2) IS NULL OR max(n3) IS NULL)""",
)
def merge_condition(t):
    books = [year_book(t, y).select("k", c("n").alias(f"n_{y}")) for y in (2001, 2000, 1999)]
    keep = (c("a") == 1) & ~((c("b") == 1) & (c("d") == 1))
    return sf.merge(books, "k", keep=keep, flags=["a", "b", "d"]).drop("a", "b", "d")


@query(
    "sql_join",
    """SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def sql_join(t):
    return (
        t.orders
        .join(t.customer, c("o_custkey") == c("c_custkey"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
        .select("o_orderkey", "c_name", "n_name", "o_totalprice")
    )


@query(
    "self_join",
    """SELECT a.id, a.ref, b.name AS manager FROM
         (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey // 10 END AS ref FROM orders) a
       LEFT JOIN (SELECT o_orderkey AS id, o_orderpriority AS name FROM orders) b ON a.ref = b.id""",
)
def self_join(t):
    staff = t.orders.select(
        c("o_orderkey").alias("id"),
        F.when(c("o_orderkey") % 10 != 0, sf.idiv(c("o_orderkey"), F.lit(10))).alias("ref"),
        c("o_orderpriority").alias("name"),
    )
    return sf.lookup_self(staff, "id", "ref", {"name": "manager"}).drop("name")


@query(
    "not_in_antijoin",
    f"""SELECT a.k, a.n, a.total FROM {CURR} a
        WHERE NOT EXISTS (SELECT 1 FROM {PREV} b WHERE a.k IS NOT DISTINCT FROM b.k)""",
)
def not_in_antijoin(t):
    return sf.not_in(year_book(t, 2001), year_book(t, 2000), "k")


@query(
    "scalar_subquery",
    """SELECT o_orderkey, o_totalprice, (SELECT max(o_totalprice) FROM orders) AS top FROM orders
       WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders) * 0.8""",
)
def scalar_subquery(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    return sf.with_scalar(df, "top", t.orders, F.max("o_totalprice")).where(c("o_totalprice") > c("top") * 0.8)


@query(
    "stack_tables",
    """SELECT o_orderkey, o_totalprice, 'F' AS origin FROM orders WHERE o_orderstatus = 'F' UNION ALL
       SELECT o_orderkey, o_totalprice, 'O' FROM orders WHERE o_orderstatus = 'O' UNION ALL
       SELECT o_orderkey, o_totalprice, 'P' FROM orders WHERE o_orderstatus = 'P'""",
)
def stack_tables(t):
    parts = sf.split_by_value(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderstatus", "FOP")
    return sf.stack(*[df.drop("o_orderstatus").withColumn("origin", F.lit(v)) for v, df in parts.items()])


@query(
    "stack_uneven",
    """SELECT c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment, NULL::VARCHAR AS supplier
       FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL, s_name FROM supplier UNION ALL
       SELECT n_nationkey, NULL, NULL, NULL FROM nation""",
)
def stack_uneven(t):
    return sf.stack(
        sf.rename(t.customer.select("c_nationkey", "c_acctbal", "c_mktsegment"),
                  {"c_nationkey": "nationkey", "c_acctbal": "acctbal", "c_mktsegment": "segment"}),
        sf.rename(t.supplier.select("s_nationkey", "s_acctbal", "s_name"),
                  {"s_nationkey": "nationkey", "s_acctbal": "acctbal", "s_name": "supplier"}),
        t.nation.select(c("n_nationkey").alias("nationkey")),
    )
