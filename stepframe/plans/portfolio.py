"""A loan book as a chain of dataset steps.

Input columns: account_id, branch_id, loan_status, loan_type, outstanding_balance, current_value,
interest_rate, arrears_balance, origination_date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flag, intck, ratio, today
from ..operators import assign_when, means, merge, nodupkey, rename, top_n


def flag_high_ltv(df: DataFrame, threshold: float = 90, min_loan: float = 0) -> DataFrame:
    """Loans from ``min_loan`` with loan-to-value, a 0/1 flag and a risk label."""
    df = df.where(F.col("loan_amount") >= min_loan)
    df = df.withColumn("loan_to_value", ratio(F.col("loan_amount"), F.col("property_value")) * 100)
    return assign_when(
        df,
        [(F.col("loan_to_value") > threshold, {"high_ltv": F.lit(1), "risk_label": F.lit("HIGH")})],
        else_={"high_ltv": F.lit(0), "risk_label": F.lit("NORMAL")},
    )


def risk_band(ltv: Column) -> Column:
    return F.when(ltv > 85, "HIGH").when(ltv > 75, "MEDIUM").otherwise("LOW")


def clean(raw: DataFrame, statuses=("ACTIVE", "ARREARS"), min_balance=10_000, ltv_threshold=85, as_of=None) -> DataFrame:
    """Filter, derive, flag, and keep one row per account."""
    kept = raw.where(F.col("loan_status").isin(*statuses) & (F.col("outstanding_balance") >= min_balance))
    derived = kept.withColumns(
        {
            "loan_to_value": ratio(F.col("outstanding_balance"), F.col("current_value")) * 100,
            "monthly_payment": F.col("outstanding_balance") * (F.col("interest_rate") / 100) / 12,
            "in_arrears": flag(F.col("arrears_balance") > 0),
            "loan_age_months": intck("month", F.col("origination_date"), today(as_of)),
        }
    )
    flagged = derived.withColumn("high_ltv", flag(F.col("loan_to_value") > ltv_threshold))
    return nodupkey(flagged.drop("internal_ref", "etl_load_dt"), "account_id")


def branch_summary(accounts: DataFrame) -> DataFrame:
    out = accounts.groupBy("branch_id").agg(
        F.count(F.lit(1)).alias("total_accounts"),
        F.sum("outstanding_balance").alias("total_book"),
        F.avg("loan_to_value").alias("avg_ltv"),
        F.sum("high_ltv").alias("high_ltv_count"),
        F.sum("in_arrears").alias("arrears_count"),
        F.sum("arrears_balance").alias("total_arrears"),
    )
    return out.withColumn("risk_band", risk_band(F.col("avg_ltv"))).orderBy(F.desc("total_book"))


def portfolio_stats(accounts: DataFrame) -> DataFrame:
    return means(
        accounts,
        ["outstanding_balance", "loan_to_value", "interest_rate", "loan_age_months"],
        ["mean", "std"],
        by=["loan_type", "high_ltv"],
    )


def loan_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Accounts of this month as NEW or EXISTING, with the change since the month before."""
    prev = rename(previous, {"outstanding_balance": "prev_balance", "loan_to_value": "prev_ltv"})
    # one row per account on both sides
    both = merge([current, prev], "account_id", keep="left", flags=["curr", "prev"], split_hot=False)
    out = assign_when(
        both,
        [
            (F.col("prev") == 0, {"change_flag": F.lit("NEW")}),
            (
                F.col("prev") == 1,
                {
                    "change_flag": F.lit("EXISTING"),
                    "balance_change": F.col("outstanding_balance") - F.col("prev_balance"),
                    "ltv_change": F.col("loan_to_value") - F.col("prev_ltv"),
                },
            ),
        ],
    )
    return out.drop("curr", "prev")


def top_risk(changes: DataFrame, n: int = 5) -> DataFrame:
    return top_n(changes, "branch_id", ["-loan_to_value", "account_id"], n, ties=False)


def run(raw: DataFrame, previous: DataFrame, **options) -> dict[str, DataFrame]:
    """All steps; every result is a lazy DataFrame."""
    accounts = clean(raw, **options)
    changes = loan_changes(accounts, previous)
    return {
        "accounts": accounts,
        "branch_summary": branch_summary(accounts),
        "portfolio_stats": portfolio_stats(accounts),
        "loan_changes": changes,
        "top_risk": top_risk(changes),
    }
