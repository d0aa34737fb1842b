"""Queries over projections, filters, predicates and column lists."""

from __future__ import annotations

from pyspark.sql import functions as F

import stepframe as sf

from .portfolio import flag_high_ltv
from .registry import query

c = F.col


@query(
    "where_filter",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice >= 100000""",
)
def where_filter(t):
    return t.orders.where((c("o_orderstatus") == "F") & (c("o_totalprice") >= 100000)).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(
    "subsetting_if",
    """SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                             l_extendedprice / l_quantity AS unit_price FROM lineitem)
       WHERE unit_price > 2000""",
)
def subsetting_if(t):
    derived = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        sf.ratio(c("l_extendedprice"), c("l_quantity")).alias("unit_price"),
    )
    return sf.subset_if(derived, c("unit_price") > 2000)


@query(
    "predicate_mix",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem
       WHERE l_returnflag IN ('A', 'R') AND NOT (l_linestatus = 'O' OR l_quantity <= 5)
         AND l_discount <> 0.05 AND l_tax BETWEEN 0.02 AND 0.06 AND l_linenumber > 2""",
)
def predicate_mix(t):
    return t.lineitem.where(
        c("l_returnflag").isin("A", "R")
        & ~((c("l_linestatus") == "O") | (c("l_quantity") <= 5))
        & (c("l_discount") != 0.05)
        & c("l_tax").between(0.02, 0.06)
        & (c("l_linenumber") > 2)
    ).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount")


@query(
    "missing_filter",
    """SELECT * FROM (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v
                      FROM events) WHERE v IS NOT NULL""",
)
def missing_filter(t):
    v = F.when(c("event_type") != "error", c("value"))
    return t.events.select("event_id", "user_id", v.alias("v")).where(c("v").isNotNull())


@query(
    "derived_columns",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
              l_extendedprice / nullif(l_quantity - 1, 0) * 100 AS loan_to_value,
              l_extendedprice * (l_discount / 100) / 12 AS monthly_payment FROM lineitem""",
)
def derived_columns(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (sf.ratio(c("l_extendedprice"), c("l_quantity") - 1) * 100).alias("loan_to_value"),
        (c("l_extendedprice") * (c("l_discount") / 100) / 12).alias("monthly_payment"),
    )


@query(
    "if_then_else",
    """SELECT o_orderkey, CASE WHEN nullif(o_totalprice, 112946.26) > 250000 THEN 1 ELSE 0 END AS high_value,
              CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent FROM orders""",
)
def if_then_else(t):
    return t.orders.select(
        "o_orderkey",
        sf.flag(F.nullif(c("o_totalprice"), F.lit(112946.26)) > 250000).alias("high_value"),
        sf.flag(c("o_orderpriority") == "1-URGENT").alias("urgent"),
    )


@query(
    "do_group_assign",
    """SELECT o_orderkey,
              CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS risk,
              CASE WHEN o_totalprice > 300000 THEN 'HIGH' WHEN o_totalprice > 100000 THEN 'MEDIUM'
                   ELSE 'NORMAL' END AS risk_label,
              CASE WHEN o_totalprice > 300000 THEN o_totalprice - 300000 END AS excess
       FROM orders""",
)
def do_group_assign(t):
    price = c("o_totalprice")
    return sf.assign_when(
        t.orders.select("o_orderkey", "o_totalprice"),
        [
            (price > 300000, {"risk": F.lit(2), "risk_label": F.lit("HIGH"), "excess": price - 300000}),
            (price > 100000, {"risk": F.lit(1), "risk_label": F.lit("MEDIUM")}),
        ],
        else_={"risk": F.lit(0), "risk_label": F.lit("NORMAL")},
    ).drop("o_totalprice")


@query(
    "bool_as_int",
    """SELECT p_partkey, CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS expensive,
              CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS large FROM part""",
)
def bool_as_int(t):
    return t.part.select(
        "p_partkey", sf.flag(c("p_retailprice") > 1000).alias("expensive"), sf.flag(c("p_size") > 25).alias("large")
    )


@query(
    "case_when_risk_band",
    """SELECT l_suppkey, o_orderpriority, count(*) AS total_loans, round(sum(l_extendedprice), 2) AS total_exposure,
              round(avg(l_extendedprice / o_totalprice * 100), 6) AS avg_ltv,
              min(l_discount) AS min_rate, max(l_discount) AS max_rate,
              CASE WHEN count(*) > 10 THEN 10 ELSE count(*) END AS capped,
              CASE WHEN avg(l_extendedprice / o_totalprice * 100) > 85 THEN 'HIGH RISK'
                   WHEN avg(l_extendedprice / o_totalprice * 100) > 75 THEN 'MEDIUM RISK'
                   ELSE 'LOW RISK' END AS risk_band
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       WHERE l_linestatus = 'F' AND l_suppkey IS NOT NULL
       GROUP BY l_suppkey, o_orderpriority""",
)
def case_when_risk_band(t):
    loans = t.lineitem.where((c("l_linestatus") == "F") & c("l_suppkey").isNotNull()).join(
        t.orders, c("l_orderkey") == c("o_orderkey")
    )
    ltv = F.avg(sf.ratio(c("l_extendedprice"), c("o_totalprice")) * 100)
    return loans.groupBy("l_suppkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("total_loans"),
        F.round(F.sum("l_extendedprice"), 2).alias("total_exposure"),
        F.round(ltv, 6).alias("avg_ltv"),
        F.min("l_discount").alias("min_rate"),
        F.max("l_discount").alias("max_rate"),
        sf.cap(F.count(F.lit(1)), 10).cast("bigint").alias("capped"),
        F.when(ltv > 85, "HIGH RISK").when(ltv > 75, "MEDIUM RISK").otherwise("LOW RISK").alias("risk_band"),
    )


@query("keep_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def keep_columns(t):
    return t.customer.select("c_custkey", "c_mktsegment")


@query("drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(t):
    return t.customer.drop("c_name", "c_acctbal")


@query(
    "rename_columns",
    "SELECT n_nationkey AS n_regionkey, n_regionkey AS n_nationkey, n_name AS nation FROM nation",
)
def rename_columns(t):
    return sf.rename(
        t.nation, {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "n_name": "nation"}
    )


@query(
    "label_metadata",
    """SELECT s_suppkey, s_acctbal, 'Account balance' AS acctbal_label, 'dollar12.2' AS acctbal_format
       FROM supplier""",
)
def label_metadata(t):
    df = sf.set_format(sf.label(t.supplier, {"s_acctbal": "Account balance"}), {"s_acctbal": "dollar12.2"})
    meta = df.schema["s_acctbal"].metadata
    return df.select(
        "s_suppkey", "s_acctbal",
        F.lit(meta["label"]).alias("acctbal_label"), F.lit(meta["format"]).alias("acctbal_format"),
    )


@query(
    "dataset_copies",
    """SELECT 'plate' || i AS copy, s_suppkey, s_name FROM supplier, (SELECT unnest(range(1, 6)) AS i)""",
)
def dataset_copies(t):
    made = sf.copies(t.supplier.select("s_suppkey", "s_name"), "plate", 5)
    return sf.stack(*[df.withColumn("copy", F.lit(name)) for name, df in made.items()])


@query("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def select_distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "calculated_alias",
    """SELECT * FROM (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS orders_of_customer
                      FROM orders) WHERE orders_of_customer > 12""",
)
def calculated_alias(t):
    keyed = t.orders.select("o_orderkey", "o_custkey")
    counted = sf.remerge(keyed, "o_custkey", {"orders_of_customer": F.count(F.lit(1))})
    return counted.where(c("orders_of_customer") > 12)


def exams(t):
    """Lineitem numbers as five marks with missing values."""
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.when(c("l_quantity") > 10, c("l_quantity")).alias("sub1"),
        F.when(c("l_discount") > 0.02, c("l_discount") * 1000).alias("sub2"),
        F.when(c("l_tax") > 0.02, c("l_tax") * 1000).alias("sub3"),
        F.when(c("l_linenumber") < 5, c("l_linenumber")).alias("sub4"),
        F.when(c("l_returnflag") == "R", c("l_extendedprice")).alias("sub5"),
    )


EXAMS = """SELECT l_orderkey, l_partkey, l_suppkey,
    CASE WHEN l_quantity > 10 THEN l_quantity END AS sub1,
    CASE WHEN l_discount > 0.02 THEN l_discount * 1000 END AS sub2,
    CASE WHEN l_tax > 0.02 THEN l_tax * 1000 END AS sub3,
    CASE WHEN l_linenumber < 5 THEN l_linenumber END AS sub4,
    CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS sub5 FROM lineitem"""


@query(
    "array_fill_static",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, coalesce(sub1, 10000) AS sub1, coalesce(sub2, 10000) AS sub2,
               coalesce(sub3, 10000) AS sub3, coalesce(sub4, 10000) AS sub4, sub5 FROM ({EXAMS})""",
)
def array_fill_static(t):
    return sf.fill(exams(t), ["sub1", "sub2", "sub3", "sub4"], 10000)


@query(
    "array_fill_numeric",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, coalesce(sub1, 0) AS sub1, coalesce(sub2, 0) AS sub2,
               coalesce(sub3, 0) AS sub3, coalesce(sub4, 0) AS sub4, coalesce(sub5, 0) AS sub5 FROM ({EXAMS})""",
)
def array_fill_numeric(t):
    df = exams(t)
    return sf.fill(df, sf.numeric_columns(df), 0)


@query(
    "array_numbered",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, sub1, coalesce(sub2, 0) AS sub2, coalesce(sub3, 0) AS sub3,
               coalesce(sub4, 0) AS sub4, coalesce(sub5, 0) AS sub5 FROM ({EXAMS})""",
)
def array_numbered(t):
    df = exams(t)
    return sf.fill(df, sf.numbered(df, "sub", 2, 20), 0)


@query(
    "array_map",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, sub1 * 2 + 1 AS sub1, sub2 * 2 + 1 AS sub2, sub3 * 2 + 1 AS sub3,
               sub4, sub5, 3 AS dim FROM ({EXAMS})""",
)
def array_map(t):
    cols = ["sub1", "sub2", "sub3"]
    return sf.map_columns(exams(t), cols, lambda x: x * 2 + 1).withColumn("dim", F.lit(len(cols)))


@query(
    "delete_rows",
    """SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v
                                FROM events) WHERE v >= 10 OR v IS NULL""",
)
def delete_rows(t):
    v = F.when(c("event_type") != "error", c("value"))
    return sf.delete_rows(t.events.select("event_id", v.alias("v")), c("v") < 10)


@query(
    "select_when",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
                             ELSE -1 END AS code FROM events""",
)
def select_when(t):
    codes = {"view": F.lit(0), "click": F.lit(1), "purchase": F.lit(2)}
    return t.events.select("event_id", sf.select_when(c("event_type"), codes, F.lit(-1)).alias("code"))


@query(
    "plain_select",
    """SELECT o_orderkey, o_totalprice * 1.1 AS with_tax FROM orders WHERE o_totalprice > 200000""",
)
def plain_select(t):
    return t.spark.sql(
        "SELECT o_orderkey, o_totalprice * 1.1D AS with_tax FROM {src} WHERE o_totalprice > :least",
        args={"least": 200000},
        src=t.orders,
    )


@query(
    "macro_step",
    """SELECT l_orderkey, l_partkey, l_suppkey, loan_amount, ltv AS loan_to_value,
              CASE WHEN ltv > 85 THEN 1 ELSE 0 END AS high_ltv,
              CASE WHEN ltv > 85 THEN 'HIGH' ELSE 'NORMAL' END AS risk_label
       FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice AS loan_amount,
                    l_extendedprice / o_totalprice * 100 AS ltv
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice >= 50000)""",
)
def macro_step(t):
    loans = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey",
        c("l_extendedprice").alias("loan_amount"), c("o_totalprice").alias("property_value"),
    )
    return loans.transform(flag_high_ltv, threshold=85, min_loan=50000).drop("property_value")
