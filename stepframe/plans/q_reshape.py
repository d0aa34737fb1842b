"""Queries over transposition and row generation."""

from __future__ import annotations

from pyspark.sql import functions as F

import stepframe as sf

from .registry import query

c = F.col


@query(
    "transpose_long",
    """SELECT p_partkey, variable, value FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part)
       UNPIVOT INCLUDE NULLS (value FOR variable IN (p_size, p_retailprice))""",
)
def transpose_long(t):
    return sf.to_long(t.part, "p_partkey", ["p_size", "p_retailprice"])


MONTHS = [f"m{i}" for i in range(1, 13)]


@query(
    "transpose_wide",
    "SELECT o_custkey, "
    + ", ".join(f"max(CASE WHEN m = {i} THEN s END) AS m{i}" for i in range(1, 13))
    + """ FROM (SELECT o_custkey, month(o_orderdate) AS m, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY ALL)
       GROUP BY o_custkey""",
)
def transpose_wide(t):
    monthly = t.orders.groupBy("o_custkey", F.concat(F.lit("m"), F.month("o_orderdate")).alias("m")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("s")
    )
    return sf.to_wide(monthly, "o_custkey", "m", "s", MONTHS)


@query(
    "expand_months",
    """SELECT user_id, m::DATE AS month_start,
              ['JANUARY', 'FEBRUARY', 'MARCH', 'APRIL', 'MAY', 'JUNE', 'JULY', 'AUGUST', 'SEPTEMBER', 'OCTOBER',
               'NOVEMBER', 'DECEMBER'][month(m)] AS month_name
       FROM (SELECT o_orderkey AS user_id, unnest(generate_series(date_trunc('month', o_orderdate),
                    date_trunc('month', o_orderdate + to_days(CAST(o_orderkey % 200 AS INTEGER) - 30)),
                    INTERVAL 1 MONTH)) AS m FROM orders)""",
)
def expand_months(t):
    start = c("o_orderdate").cast("date")
    members = t.orders.select(
        c("o_orderkey").alias("user_id"),
        start.alias("jdate"),
        F.date_add(start, (c("o_orderkey") % 200).cast("int") - 30).alias("edate"),
    )
    return sf.expand_months(members, "jdate", "edate").drop("jdate", "edate")


@query(
    "do_range",
    """SELECT p_partkey, unnest(range(1, p_size % 7 + 1)) AS i FROM part""",
)
def do_range(t):
    return sf.expand_range(t.part.select("p_partkey", "p_size"), F.lit(1), c("p_size") % 7).drop("p_size")


@query(
    "do_while_rows",
    "SELECT p_partkey, unnest(range(p_size::BIGINT, 20)) AS x FROM part",
)
def do_while_rows(t):
    made = sf.generate(
        t.part.select("p_partkey", "p_size"),
        {"x": c("p_size").cast("bigint")},
        cond=lambda s: s["x"] < 20,
        step=lambda s: {"x": s["x"] + 1},
        output="before",
    )
    return made.select("p_partkey", "x")


@query(
    "do_until_rows",
    "SELECT p_partkey, unnest(range(p_size::BIGINT, greatest(p_size::BIGINT + 1, 21))) AS x FROM part",
)
def do_until_rows(t):
    made = sf.generate(
        t.part.select("p_partkey", "p_size"),
        {"x": c("p_size").cast("bigint")},
        cond=lambda s: s["x"] > 20,
        step=lambda s: {"x": s["x"] + 1},
        until=True,
        output="before",
    )
    return made.select("p_partkey", "x")


@query(
    "payment_schedule",
    """WITH RECURSIVE s AS (
         SELECT o_orderkey, 0::BIGINT AS month, o_totalprice AS balance, 0.0::DOUBLE AS interest,
                o_totalprice * 0.04 + 500 AS payment FROM orders
         UNION ALL
         SELECT o_orderkey, month + 1,
                CASE WHEN balance + balance * 0.005 - payment < 0 THEN 0 ELSE balance + balance * 0.005 - payment END,
                balance * 0.005, payment FROM s WHERE balance > 0)
       SELECT o_orderkey, month, balance, interest FROM s WHERE month > 0""",
)
def payment_schedule(t):
    loans = t.orders.select("o_orderkey", "o_totalprice")

    def pay(s):
        interest = s["balance"] * 0.005
        left = s["balance"] + interest - s["payment"]
        return {"interest": interest, "balance": left.mask(left < 0, 0.0)}

    made = sf.generate(
        loans,
        {
            "balance": c("o_totalprice"),
            "interest": F.lit(0.0),
            "payment": c("o_totalprice") * 0.04 + 500,
        },
        cond=lambda s: s["balance"] > 0,
        step=pay,
    )
    return made.select("o_orderkey", c("step_no").alias("month"), "balance", "interest")


@query(
    "compound_growth",
    """WITH RECURSIVE g AS (
         SELECT c_custkey, 1::BIGINT AS years, c_acctbal * 1.07 AS amount, c_acctbal * 2 AS target FROM customer
         UNION ALL
         SELECT c_custkey, years + 1, amount * 1.07, target FROM g WHERE NOT amount >= target)
       SELECT c_custkey, years, amount FROM g""",
)
def compound_growth(t):
    funds = t.customer.select("c_custkey", "c_acctbal")
    made = sf.generate(
        funds,
        {"amount": c("c_acctbal"), "target": c("c_acctbal") * 2},
        cond=lambda s: s["amount"] >= s["target"],
        step=lambda s: {"amount": s["amount"] * 1.07},
        until=True,
    )
    return made.select("c_custkey", c("step_no").alias("years"), "amount")
