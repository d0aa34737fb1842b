"""Queries over BY-group steps and steps over the whole table in order."""

from __future__ import annotations

from pyspark.sql import functions as F

import stepframe as sf

from .registry import query

c = F.col


def swipes(t):
    """Events as card swipes; errors have no amount."""
    return t.events.select(
        "event_id", "user_id", "event_type", "ts",
        F.when(c("event_type") != "error", c("value")).alias("swipe"),
    )


SWIPES = """(SELECT event_id, user_id, event_type, ts,
             CASE WHEN event_type <> 'error' THEN value END AS swipe FROM events)"""
ORDER = ["ts", "event_id"]


def slim(df, *drop):
    return df.drop("ts", *drop)


@query(
    "by_first_last_flags",
    f"""SELECT event_id, user_id, event_type, swipe,
               CASE WHEN row_number() OVER (a) = 1 THEN 1 ELSE 0 END AS first_event_type,
               CASE WHEN row_number() OVER (az) = 1 THEN 1 ELSE 0 END AS last_event_type,
               CASE WHEN row_number() OVER (b) = 1 THEN 1 ELSE 0 END AS first_user_id,
               CASE WHEN row_number() OVER (bz) = 1 THEN 1 ELSE 0 END AS last_user_id
        FROM {SWIPES} WINDOW
          a AS (PARTITION BY event_type ORDER BY user_id, ts, event_id),
          az AS (PARTITION BY event_type ORDER BY user_id DESC, ts DESC, event_id DESC),
          b AS (PARTITION BY event_type, user_id ORDER BY ts, event_id),
          bz AS (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC)""",
)
def by_first_last_flags(t):
    return slim(sf.by_flags(swipes(t), ["event_type", "user_id"], ORDER, ties=False))


@query(
    "by_counter",
    f"""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS swipe_count
        FROM {SWIPES}""",
)
def by_counter(t):
    out = sf.by_counter(swipes(t), "user_id", ORDER, "swipe_count", ties=False)
    return slim(out, "event_type", "swipe")


@query(
    "running_sum",
    f"""SELECT event_id, user_id, swipe, round(sum(swipe) OVER (PARTITION BY user_id ORDER BY ts, event_id
               ROWS UNBOUNDED PRECEDING), 2) AS total FROM {SWIPES}""",
)
def running_sum(t):
    out = sf.running_sum(swipes(t), "swipe", "user_id", ORDER, "total", ties=False)
    return slim(out, "event_type").withColumn("total", F.round("total", 2))


@query(
    "running_sum_last",
    f"""SELECT event_id, user_id, event_type, swipe, total, n FROM
        (SELECT *, round(sum(swipe) OVER (PARTITION BY user_id), 2) AS total, count(*) OVER (PARTITION BY user_id) AS n,
                row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {SWIPES})
        WHERE rn = 1""",
)
def running_sum_last(t):
    totals = {"total": F.round(F.sum("swipe"), 2), "n": F.count(F.lit(1))}
    return slim(sf.by_total(swipes(t), "user_id", ORDER, totals, ties=False))


@query(
    "running_sum_threshold",
    f"""SELECT user_id, event_type, round(sum(swipe), 2) AS swipe_500 FROM {SWIPES} GROUP BY ALL
        HAVING sum(swipe) > 500""",
)
def running_sum_threshold(t):
    total = F.sum("swipe")
    grouped = swipes(t).groupBy("user_id", "event_type").agg(total.alias("t"))
    return grouped.where("t > 500").select("user_id", "event_type", F.round("t", 2).alias("swipe_500"))


@query(
    "nested_by_outer",
    f"""SELECT event_id, user_id, event_type, swipe, n AS count FROM
        (SELECT *, count(*) OVER (PARTITION BY event_type) AS n,
                row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, ts DESC, event_id DESC) AS rn
         FROM {SWIPES}) WHERE rn = 1""",
)
def nested_by_outer(t):
    return slim(sf.nested_by_outer(swipes(t), "event_type", "user_id", ORDER, ties=False))


@query(
    "nested_by_inner",
    f"""SELECT event_id, user_id, event_type, swipe, n AS count FROM
        (SELECT *, count(*) OVER (PARTITION BY event_type, user_id) AS n,
                row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn
         FROM {SWIPES}) WHERE rn = 1""",
)
def nested_by_inner(t):
    return slim(sf.nested_by_inner(swipes(t), "event_type", "user_id", ORDER, ties=False))


@query(
    "top_n_per_group",
    f"""SELECT event_id, user_id, swipe, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY swipe DESC NULLS LAST, event_id) AS rn FROM {SWIPES}) WHERE rn <= 3""",
)
def top_n_per_group(t):
    cards = swipes(t).select("event_id", "user_id", "swipe")
    return sf.top_n(cards, "user_id", ["-swipe", "event_id"], 3, "rank")


@query(
    "nth_row_per_group",
    f"""SELECT event_id, user_id, event_type, swipe FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
        ORDER BY ts, event_id) AS rn FROM {SWIPES}) WHERE rn = 2""",
)
def nth_row_per_group(t):
    return slim(sf.nth_row(swipes(t), ["user_id", "event_type"], ORDER, 2, ties=False))


@query(
    "third_or_second",
    """SELECT o_orderkey, o_custkey, d, o_totalprice FROM
       (SELECT o_orderkey, o_custkey, year(o_orderdate) AS d, o_totalprice,
               row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS rn,
               count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS n FROM orders)
       WHERE rn = 3 OR (rn = 2 AND n = 2)""",
)
def third_or_second(t):
    marks = t.orders.select("o_orderkey", "o_custkey", sf.year(c("o_orderdate")).alias("d"), "o_totalprice")
    return sf.third_or_second(marks, ["o_custkey", "d"], ["-o_totalprice", "o_orderkey"])


@query(
    "first_row_per_group",
    f"""SELECT event_id, user_id, event_type, swipe FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE
        ORDER BY ts, event_id) AS rn FROM {SWIPES}) WHERE rn = 1""",
)
def first_row_per_group(t):
    daily = swipes(t).withColumn("d", c("ts").cast("date"))
    return slim(sf.first_row(daily, ["user_id", "d"], ORDER, ties=False), "d")


@query(
    "last_row_per_group",
    f"""SELECT event_id, user_id, event_type, swipe FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY ts DESC, event_id DESC) AS rn FROM {SWIPES}) WHERE rn = 1""",
)
def last_row_per_group(t):
    return slim(sf.last_row(swipes(t), "user_id", ORDER, ties=False))


def cars(t):
    return t.lineitem.select("l_orderkey", "l_partkey", c("l_suppkey").alias("make"), c("l_quantity").alias("invoice"))


CARS = "(SELECT l_orderkey, l_partkey, l_suppkey AS make, l_quantity AS invoice FROM lineitem)"


@query(
    "rank_count_ge",
    f"""WITH v AS (SELECT make, invoice, count(*) AS n FROM {CARS} GROUP BY ALL),
             r AS (SELECT a.make, a.invoice, sum(b.n)::BIGINT AS rank FROM v a
                   JOIN v b ON a.make = b.make AND b.invoice >= a.invoice GROUP BY ALL)
        SELECT l_orderkey, l_partkey, x.make, x.invoice, rank FROM {CARS} x JOIN r USING (make, invoice)
        WHERE rank <= 20""",
)
def rank_count_ge(t):
    return sf.count_ge(cars(t), "make", "invoice").where("rank <= 20")


@query(
    "rank_min",
    f"""SELECT * FROM (SELECT l_orderkey, l_partkey, make, invoice,
        rank() OVER (PARTITION BY make ORDER BY invoice DESC) AS rank FROM {CARS}) WHERE rank <= 20""",
)
def rank_min(t):
    return sf.rank_min(cars(t), "make", "invoice").where("rank <= 20")


@query(
    "global_row_number",
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_num
       FROM orders""",
)
def global_row_number(t):
    prices = t.orders.select("o_orderkey", "o_totalprice")
    return sf.row_index(prices, ["-o_totalprice", "o_orderkey"])


@query(
    "row_number_top",
    """SELECT * FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)
       AS row_num FROM orders) WHERE row_num <= 5""",
)
def row_number_top(t):
    prices = t.orders.select("o_orderkey", "o_totalprice")
    first = sf.head(prices, 5, ["-o_totalprice", "o_orderkey"])
    return sf.row_index(first, ["-o_totalprice", "o_orderkey"])


@query(
    "lag_by_group",
    f"""SELECT event_id, user_id, swipe, lag(swipe, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag1val
        FROM {SWIPES}""",
)
def lag_by_group(t):
    return slim(sf.lag(swipes(t), "swipe", 1, ORDER, "user_id", "lag1val", ties=False), "event_type")


@query(
    "lag_global",
    f"""SELECT event_id, swipe, lag(swipe, 3) OVER (ORDER BY ts, event_id) AS lag3_swipe FROM {SWIPES}""",
)
def lag_global(t):
    return slim(sf.lag(swipes(t), "swipe", 3, ORDER, ties=False), "event_type", "user_id")


@query(
    "running_sum_global",
    f"""SELECT event_id, swipe, round(coalesce(sum(swipe) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0), 2)
               AS total FROM {SWIPES}""",
)
def running_sum_global(t):
    out = sf.running_sum(swipes(t), "swipe", None, ORDER, "total", ties=False)
    return slim(out, "event_type", "user_id").withColumn("total", F.round("total", 2))


@query(
    "retain_fold",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, value,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
         f AS (SELECT event_id, user_id, value, rn,
                      CASE WHEN value > 10 THEN 0.0::DOUBLE * 0.5 + value ELSE 0.0::DOUBLE + 1 END AS s
               FROM e WHERE rn = 1
               UNION ALL
               SELECT e.event_id, e.user_id, e.value, e.rn,
                      CASE WHEN e.value > 10 THEN f.s * 0.5 + e.value ELSE f.s + 1 END
               FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
       SELECT event_id, user_id, s AS state FROM f""",
)
def retain_fold(t):
    rows = t.events.select("event_id", "user_id", "ts", "value")

    def step(s, r):
        return s * 0.5 + r.value if r.value is not None and r.value > 10 else s + 1

    out = sf.retain_fold(rows, "user_id", ORDER, 0.0, step, using=["value"], ties=False)
    return out.select("event_id", "user_id", "state")


@query(
    "point_access",
    """WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders)
       SELECT seq, position, o_orderkey, o_totalprice FROM
         (VALUES (1::BIGINT, 2::BIGINT), (2, 1), (3, 700), (4, 4), (5, 2)) p(seq, position) JOIN o ON rn = position""",
)
def point_access(t):
    prices = t.orders.select("o_orderkey", "o_totalprice")
    return sf.point(prices, [2, 1, 700, 4, 2], ["o_totalprice", "o_orderkey"])


@query(
    "first_value",
    """SELECT c_custkey, (SELECT o_orderpriority FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1) AS nvar
       FROM customer""",
)
def first_value(t):
    first = sf.first_value(t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderpriority",
                           ["o_orderdate", "o_orderkey"])
    return t.customer.select("c_custkey").withColumn("nvar", first)


@query(
    "split_n_parts",
    """SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)
               // ceil((SELECT count(*) FROM orders) / 7.0)::BIGINT + 1)::BIGINT AS part_no FROM orders""",
)
def split_n_parts(t):
    dated = t.orders.select("o_orderkey", "o_orderdate")
    return sf.split_n(dated, 7, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "dedupe_first_seen",
    """SELECT event_type, props, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, props
       ORDER BY event_id) AS rn FROM events) WHERE rn = 1""",
)
def dedupe_first_seen(t):
    notes = t.events.select("event_type", "props", "event_id")
    return sf.dedupe_first(notes, ["event_type", "props"], "event_id")
