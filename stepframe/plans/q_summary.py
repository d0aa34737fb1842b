"""Queries over aggregates, statistics by class, frequency tables and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

import stepframe as sf

from .registry import query

c = F.col


@query(
    "group_summary",
    """SELECT l_suppkey, count(*) AS total_loans, round(sum(l_extendedprice), 2) AS total_exposure,
              round(avg(l_discount), 6) AS avg_rate, min(l_tax) AS min_tax, max(l_tax) AS max_tax
       FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_suppkey""",
)
def group_summary(t):
    return (
        t.lineitem.where("l_linestatus = 'O'")
        .groupBy("l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("total_loans"),
            F.round(F.sum("l_extendedprice"), 2).alias("total_exposure"),
            F.round(F.avg("l_discount"), 6).alias("avg_rate"),
            F.min("l_tax").alias("min_tax"),
            F.max("l_tax").alias("max_tax"),
        )
        .orderBy(F.desc("total_exposure"))
    )


@query(
    "conditional_count",
    """SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END)::BIGINT AS high,
              sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished
       FROM orders GROUP BY o_custkey""",
)
def conditional_count(t):
    return t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(sf.flag(c("o_totalprice") > 250000)).alias("high"),
        F.sum(sf.flag(c("o_orderstatus") == "F")).alias("finished"),
    )


def classed(t):
    """Lineitem with a class that is missing for some rows and a value that is missing for others."""
    return t.lineitem.select(
        F.when(c("l_returnflag") != "N", c("l_returnflag")).alias("kind"),
        "l_linestatus",
        F.when(c("l_quantity") > 5, c("l_quantity")).alias("qty"),
        c("l_extendedprice").alias("price"),
    )


CLASSED = """(SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS kind, l_linestatus,
    CASE WHEN l_quantity > 5 THEN l_quantity END AS qty, l_extendedprice AS price FROM lineitem)"""


def _rounded(df, digits=4):
    """Doubles rounded for comparison; sums of many doubles depend on their order."""
    kinds = dict(df.dtypes)
    return df.select([F.round(n, digits).alias(n) if kinds[n] == "double" else c(n) for n in df.columns])


@query(
    "means_overall",
    f"""SELECT 'qty' AS variable, count(qty)::DOUBLE AS n, round(avg(qty), 4) AS mean, round(stddev_samp(qty), 4) AS std,
               min(qty) AS min, max(qty) AS max FROM {CLASSED} UNION ALL
        SELECT 'price', count(price), round(avg(price), 4), round(stddev_samp(price), 4), min(price), max(price)
        FROM {CLASSED}""",
)
def means_overall(t):
    return _rounded(sf.means(classed(t), ["qty", "price"], long=True))


@query(
    "means_by_class",
    f"""SELECT kind, l_linestatus, count(qty) AS qty_n, round(avg(qty), 4) AS qty_mean,
               round(stddev_samp(qty), 4) AS qty_std, min(qty) AS qty_min, max(qty) AS qty_max,
               count(price) AS price_n, round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_std,
               min(price) AS price_min, max(price) AS price_max
        FROM {CLASSED} WHERE kind IS NOT NULL GROUP BY kind, l_linestatus""",
)
def means_by_class(t):
    return _rounded(sf.means(classed(t), ["qty", "price"], by=["kind", "l_linestatus"]))


@query(
    "means_with_missing",
    f"""SELECT kind, count(qty) AS qty_n, round(sum(price), 2) AS price_sum, count(price) AS price_n,
               round(sum(qty), 2) AS qty_sum FROM {CLASSED} GROUP BY kind""",
)
def means_with_missing(t):
    return _rounded(sf.means(classed(t), ["qty", "price"], ["n", "sum"], by="kind", include_missing=True), 2)


@query(
    "means_all_stats",
    f"""SELECT kind, count(qty) AS qty_n, round(avg(qty), 4) AS qty_mean, round(stddev_samp(qty), 4) AS qty_std,
               min(qty) AS qty_min, max(qty) AS qty_max, sum(qty) AS qty_sum,
               quantile_cont(qty, 0.5) AS qty_median, round(var_samp(qty), 4) AS qty_var
        FROM {CLASSED} WHERE kind IS NOT NULL GROUP BY kind""",
)
def means_all_stats(t):
    stats = ["n", "mean", "std", "min", "max", "sum", "median", "var"]
    return _rounded(sf.means(classed(t), "qty", stats, by="kind"))


@query(
    "means_quantiles",
    f"""SELECT l_linestatus, round(100 * stddev_samp(price) / avg(price), 4) AS price_cv,
               round(quantile_cont(price, 0.25), 4) AS price_p25, round(quantile_cont(price, 0.75), 4) AS price_p75,
               round(100 * stddev_samp(qty) / avg(qty), 4) AS qty_cv,
               round(quantile_cont(qty, 0.25), 4) AS qty_p25, round(quantile_cont(qty, 0.75), 4) AS qty_p75
        FROM {CLASSED} GROUP BY l_linestatus""",
)
def means_quantiles(t):
    return _rounded(sf.means(classed(t), ["price", "qty"], ["cv", "p25", "p75"], by="l_linestatus"))


@query(
    "means_named",
    f"""SELECT kind, round(avg(qty), 4) AS mean_qty, round(stddev_samp(qty), 4) AS std_qty,
               round(avg(price), 4) AS mean_price, round(stddev_samp(price), 4) AS std_price
        FROM {CLASSED} WHERE kind IS NOT NULL GROUP BY kind""",
)
def means_named(t):
    names = {"mean": ["mean_qty", "mean_price"], "std": ["std_qty", "std_price"]}
    return _rounded(sf.means(classed(t), ["qty", "price"], ["mean", "std"], by="kind", names=names))


@query(
    "describe_stats",
    " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, count({v})::DOUBLE AS count, round(avg({v}), 4) AS mean,
            round(stddev_samp({v}), 4) AS std, min({v}) AS min, round(quantile_cont({v}, 0.25), 4) AS p25,
            round(quantile_cont({v}, 0.5), 4) AS p50, round(quantile_cont({v}, 0.75), 4) AS p75, max({v}) AS max
            FROM {CLASSED}"""
        for v in ("qty", "price")
    ),
)
def describe_stats(t):
    return _rounded(sf.describe(classed(t), ["qty", "price"]))


@query("freq_oneway", f"SELECT kind, count(*) AS count FROM {CLASSED} WHERE kind IS NOT NULL GROUP BY kind")
def freq_oneway(t):
    return sf.freq(classed(t), "kind")


@query(
    "freq_twoway",
    f"SELECT kind, l_linestatus, count(*) AS count FROM {CLASSED} GROUP BY kind, l_linestatus",
)
def freq_twoway(t):
    return sf.freq(classed(t), ["kind", "l_linestatus"], include_missing=True)


#: all types of ``part``, and one that it does not have
PART_TYPES = ["ECONOMY", "SMALL", "LARGE", "MEDIUM", "STANDARD", "PROMO", "NONE"]


@query(
    "freq_crosstab",
    "SELECT p_brand, "
    + ", ".join(f"count(*) FILTER (p_type = '{k}') AS \"{k}\"" for k in PART_TYPES)
    + " FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY p_brand",
)
def freq_crosstab(t):
    return sf.freq(t.part, ["p_brand", "p_type"], wide=True, values=PART_TYPES)


@query(
    "count_distinct",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts
       FROM lineitem GROUP BY l_returnflag""",
)
def count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts")
    )


@query(
    "distinct_sketch",
    """SELECT year(l_shipdate)::INT AS year, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts,
              TRUE AS suppliers_near, TRUE AS parts_near FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1""",
)
def distinct_sketch(t):
    """Sketches per month and flag, united per year, beside the exact counts: within five standard errors of them."""
    lines = t.lineitem.select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_returnflag", "l_suppkey", "l_partkey")
    near = sf.sketch_counts(sf.unite_sketches(sf.distinct_sketches(lines, ["l_suppkey", "l_partkey"], ["year", "month", "l_returnflag"]), "year"))
    exact = lines.groupBy("year").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))
    close = lambda a, b: F.abs(c(a) - c(b)) <= 5 * sf.distinct_error() * c(b)
    return exact.join(near, "year").select(
        "year", "suppliers", "parts", close("l_suppkey_distinct", "suppliers").alias("suppliers_near"), close("l_partkey_distinct", "parts").alias("parts_near")
    )


@query(
    "into_list",
    """SELECT c_custkey, c_mktsegment, (SELECT string_agg(s, '@' ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s
       FROM customer)) AS segments FROM customer""",
)
def into_list(t):
    return t.customer.select("c_custkey", "c_mktsegment").withColumn(
        "segments", sf.into_list(t.customer, "c_mktsegment", "@")
    )


@query(
    "having_filter",
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey
       HAVING count(*) >= 12""",
)
def having_filter(t):
    grouped = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return grouped.where("n >= 12")


@query(
    "remerge_global_max",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem
       WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)""",
)
def remerge_global_max(t):
    items = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return sf.remerge(items, [], {"top": F.max("l_quantity")}).where(c("l_quantity") == c("top")).drop("top")


@query(
    "remerge_group",
    """SELECT o_orderkey, o_custkey, o_totalprice, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total,
              count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top
       FROM orders""",
)
def remerge_group(t):
    aggs = {
        "total": F.round(F.sum("o_totalprice"), 2), "n": F.count(F.lit(1)), "top": F.max("o_totalprice")
    }
    return sf.remerge(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", aggs)


@query(
    "groups_at_max",
    """WITH g AS (SELECT o_custkey, least(count(*), 15) AS cnt FROM orders GROUP BY o_custkey)
       SELECT o.o_custkey, o.o_totalprice, g.cnt FROM orders o JOIN g USING (o_custkey)
       WHERE g.cnt = (SELECT max(cnt) FROM g)""",
)
def groups_at_max(t):
    counted = t.orders.groupBy("o_custkey").agg(sf.cap(F.count(F.lit(1)), 15).cast("bigint").alias("cnt"))
    at_max = sf.remerge(counted, [], {"most": F.max("cnt")}).where(c("cnt") == c("most")).drop("most")
    return t.orders.select("o_custkey", "o_totalprice").join(at_max, "o_custkey")


@query(
    "min_per_group",
    """SELECT user_id, min(ts::DATE) AS first_txn_date, max(ts::DATE) AS last_txn_date, min(value) AS least
       FROM events GROUP BY user_id""",
)
def min_per_group(t):
    day = c("ts").cast("date")
    return t.events.groupBy("user_id").agg(
        F.min(day).alias("first_txn_date"), F.max(day).alias("last_txn_date"), F.min("value").alias("least")
    )


@query(
    "second_highest",
    """SELECT max(l_extendedprice) AS second_highest FROM lineitem
       WHERE l_extendedprice < (SELECT max(l_extendedprice) FROM lineitem)""",
)
def second_highest(t):
    return sf.nth_highest(t.lineitem, "l_extendedprice", 2, "second_highest")


@query("row_count", "SELECT n_name, (SELECT count(*) FROM lineitem) AS n FROM nation")
def row_count(t):
    return t.nation.select("n_name").withColumn("n", sf.row_count(t.lineitem))


@query("sort_multi", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC")
def sort_multi(t):
    return sf.sort(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "-o_totalprice"])


@query(
    "sort_nodupkey",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM
       (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity,
               l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def sort_nodupkey(t):
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return sf.nodupkey(items, ["l_orderkey", "l_linenumber"])


@query(
    "sort_where",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC",
)
def sort_where(t):
    return sf.sort(t.orders, "-o_totalprice", where=c("o_orderpriority") == "1-URGENT").select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def top_k(t):
    return sf.head(t.orders.select("o_orderkey", "o_totalprice"), 25, ["-o_totalprice"])


@query(
    "print_head",
    """SELECT event_id, user_id, event_type, value FROM events ORDER BY user_id, event_id LIMIT 10""",
)
def print_head(t):
    return sf.head(t.events.select("event_id", "user_id", "event_type", "value"), 10, ["user_id", "event_id"], ties=False)


@query(
    "bottom_n",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 7",
)
def bottom_n(t):
    return sf.tail(t.orders.select("o_orderkey", "o_totalprice"), 7, ["-o_totalprice", "o_orderkey"])
