"""The loan-book program over orders and their items."""

from __future__ import annotations

from pyspark.sql import functions as F

import stepframe as sf

from . import portfolio
from .registry import query

c = F.col
AS_OF = "2001-09-01"


def raw_loans(t):
    items = t.lineitem.groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("current_value"),
        (F.max("l_discount") * 100).alias("interest_rate"),
        F.round(F.sum(F.when(c("l_returnflag") == "R", c("l_extendedprice")).otherwise(0)), 2).alias("arrears_balance"),
    )
    return (
        t.orders.join(items, c("o_orderkey") == c("l_orderkey"), "left")
        .join(t.customer.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"), "left")
        .select(
            c("o_orderkey").alias("account_id"),
            c("c_nationkey").alias("branch_id"),
            F.when(c("o_orderstatus") == "O", "ACTIVE").when(c("o_orderstatus") == "F", "ARREARS").otherwise("CLOSED")
            .alias("loan_status"),
            c("o_orderpriority").alias("loan_type"),
            c("o_totalprice").alias("outstanding_balance"),
            "current_value", "interest_rate", "arrears_balance",
            c("o_orderdate").cast("date").alias("origination_date"),
            F.lit("x").alias("internal_ref"),
            F.current_date().alias("etl_load_dt"),
        )
    )


def previous_month(t):
    old = t.orders.where(c("o_orderdate") < F.lit("2000-07-01").cast("timestamp_ntz"))
    return old.select(
        c("o_orderkey").alias("account_id"),
        (c("o_totalprice") * 1.01).alias("outstanding_balance"),
        (c("o_totalprice") / 1000).alias("loan_to_value"),
    )


def results(t):
    return portfolio.run(raw_loans(t), previous_month(t), as_of=AS_OF)


ACCOUNTS = """(SELECT *, CASE WHEN loan_to_value > 85 THEN 1 ELSE 0 END AS high_ltv FROM (
  SELECT o_orderkey AS account_id, c_nationkey AS branch_id,
         CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' ELSE 'ARREARS' END AS loan_status, o_orderpriority AS loan_type,
         o_totalprice AS outstanding_balance, current_value, interest_rate, arrears_balance,
         o_orderdate::DATE AS origination_date, o_totalprice / current_value * 100 AS loan_to_value,
         o_totalprice * (interest_rate / 100) / 12 AS monthly_payment,
         CASE WHEN arrears_balance > 0 THEN 1 ELSE 0 END AS in_arrears,
         ((2001 - year(o_orderdate)) * 12 + 9 - month(o_orderdate))::BIGINT AS loan_age_months
  FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS current_value, max(l_discount) * 100 AS interest_rate,
         round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS arrears_balance
       FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 10000))"""

CHANGES = f"""(SELECT a.*, p.prev_balance, p.prev_ltv, CASE WHEN p.account_id IS NULL THEN 'NEW' ELSE 'EXISTING' END AS change_flag,
    outstanding_balance - prev_balance AS balance_change, loan_to_value - prev_ltv AS ltv_change
  FROM {ACCOUNTS} a LEFT JOIN (SELECT o_orderkey AS account_id, o_totalprice * 1.01 AS prev_balance, o_totalprice / 1000 AS prev_ltv
    FROM orders WHERE o_orderdate < DATE '2000-07-01') p ON a.account_id = p.account_id)"""


@query(
    "full_program",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY branch_id
        ORDER BY loan_to_value DESC NULLS LAST, account_id) AS rn FROM {CHANGES}) WHERE rn <= 5""",
)
def full_program(t):
    return results(t)["top_risk"]


@query("program_changes", f"FROM {CHANGES}")
def program_changes(t):
    return results(t)["loan_changes"]


@query(
    "program_branches",
    f"""SELECT branch_id, count(*) AS total_accounts, round(sum(outstanding_balance), 2) AS total_book,
               round(avg(loan_to_value), 4) AS avg_ltv, sum(high_ltv)::BIGINT AS high_ltv_count,
               sum(in_arrears)::BIGINT AS arrears_count, round(sum(arrears_balance), 2) AS total_arrears,
               CASE WHEN avg(loan_to_value) > 85 THEN 'HIGH' WHEN avg(loan_to_value) > 75 THEN 'MEDIUM' ELSE 'LOW' END
                 AS risk_band FROM {ACCOUNTS} GROUP BY branch_id""",
)
def program_branches(t):
    return results(t)["branch_summary"].withColumns(
        {"total_book": F.round("total_book", 2), "avg_ltv": F.round("avg_ltv", 4),
         "total_arrears": F.round("total_arrears", 2)}
    )


@query(
    "program_stats",
    "SELECT loan_type, high_ltv, "
    + ", ".join(
        f"round(avg({v}), 4) AS {v}_mean, round(stddev_samp({v}), 4) AS {v}_std"
        for v in ("outstanding_balance", "loan_to_value", "interest_rate", "loan_age_months")
    )
    + f" FROM {ACCOUNTS} GROUP BY loan_type, high_ltv",
)
def program_stats(t):
    stats = results(t)["portfolio_stats"]
    keys = ["loan_type", "high_ltv"]
    return stats.select(*keys, *[F.round(n, 4).alias(n) for n in stats.columns if n not in keys])
