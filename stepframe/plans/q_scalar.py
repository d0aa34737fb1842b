"""Queries over date, character and numeric functions."""

from __future__ import annotations

from pyspark.sql import functions as F

import stepframe as sf

from .registry import query

c = F.col
AS_OF = "2001-09-01"


def dated(t):
    d = c("o_orderdate").cast("date")
    later = F.date_add(d, (c("o_orderkey") % 900).cast("int") - 100)
    return t.orders.select("o_orderkey", d.alias("d"), later.alias("e"))


DATED = """(SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE + (o_orderkey % 900 - 100)::INTEGER AS e
            FROM orders)"""
MONTHS = "((year(e) - year(d)) * 12 + month(e) - month(d))"


@query(
    "date_parts",
    f"""SELECT o_orderkey, year(d)::BIGINT AS y, month(d)::BIGINT AS m, day(d)::BIGINT AS dd,
               ((2001 - year(d)) * 12 + 9 - month(d))::BIGINT AS age_months FROM {DATED}""",
)
def date_parts(t):
    d = c("d")
    return dated(t).select(
        "o_orderkey", sf.year(d).alias("y"), sf.month(d).alias("m"), sf.day(d).alias("dd"),
        sf.intck("month", d, sf.today(AS_OF)).alias("age_months"),
    )


@query(
    "intck_boundary",
    f"""SELECT o_orderkey, (e - d)::BIGINT AS days, {MONTHS}::BIGINT AS months, (year(e) - year(d))::BIGINT AS years,
               ((year(e) - year(d)) * 4 + quarter(e) - quarter(d))::BIGINT AS quarters,
               ((e - DATE '1959-12-27') // 7 - (d - DATE '1959-12-27') // 7)::BIGINT AS weeks FROM {DATED}""",
)
def intck_boundary(t):
    units = {"day": "days", "month": "months", "year": "years", "quarter": "quarters", "week": "weeks"}
    return dated(t).select("o_orderkey", *[sf.intck(u, c("d"), c("e")).alias(n) for u, n in units.items()])


@query(
    "intck_elapsed",
    f"""SELECT o_orderkey, floor((e - d) / 7.0)::BIGINT AS weeks, floor({MONTHS} / 3.0)::BIGINT AS quarters
        FROM {DATED}""",
)
def intck_elapsed(t):
    return dated(t).select(
        "o_orderkey",
        sf.intck("week", c("d"), c("e"), "elapsed").alias("weeks"),
        sf.intck("quarter", c("d"), c("e"), "elapsed").alias("quarters"),
    )


@query(
    "intck_continuous",
    f"""SELECT o_orderkey, ({MONTHS} - CASE WHEN day(e) < day(d) THEN 1 ELSE 0 END)::BIGINT AS months,
               (year(e) - year(d) - CASE WHEN month(e) < month(d) OR (month(e) = month(d) AND day(e) < day(d))
                                         THEN 1 ELSE 0 END)::BIGINT AS years FROM {DATED}""",
)
def intck_continuous(t):
    return dated(t).select(
        "o_orderkey",
        sf.intck("month", c("d"), c("e"), "continuous").alias("months"),
        sf.intck("year", c("d"), c("e"), "continuous").alias("years"),
    )


@query(
    "age_years",
    f"""SELECT o_orderkey, (2001 - year(d) - CASE WHEN month(d) > 9 OR (month(d) = 9 AND day(d) > 1) THEN 1 ELSE 0 END)::BIGINT
               AS age FROM {DATED}""",
)
def age_years(t):
    return dated(t).select("o_orderkey", sf.age(c("d"), AS_OF).alias("age"))


@query(
    "intnx_align",
    f"""SELECT o_orderkey, date_trunc('month', d)::DATE AS firstday, d AS sameday, last_day(d) AS lastday,
               date_trunc('month', d + INTERVAL 1 MONTH)::DATE AS nextmon, (d - INTERVAL 1 YEAR)::DATE AS lastyr,
               (date_trunc('month', d)::DATE + 14)::DATE AS middle, (d + INTERVAL 12 MONTH)::DATE AS next_review
        FROM {DATED}""",
)
def intnx_align(t):
    d = c("d")
    return dated(t).select(
        "o_orderkey",
        sf.intnx("month", d, 0, "b").alias("firstday"),
        sf.intnx("month", d, 0, "s").alias("sameday"),
        sf.intnx("month", d, 0, "e").alias("lastday"),
        sf.intnx("month", d, 1, "b").alias("nextmon"),
        sf.intnx("year", d, -1, "s").alias("lastyr"),
        sf.intnx("month", d, 0, "m").alias("middle"),
        sf.intnx("month", d, 12, "sameday").alias("next_review"),
    )


@query(
    "intnx_units",
    f"""SELECT o_orderkey, (d + 10)::DATE AS day10,
               (DATE '1959-12-27' + ((d - DATE '1959-12-27') // 7 + 2)::INTEGER * 7)::DATE AS week2_b,
               (DATE '1959-12-27' + ((d - DATE '1959-12-27') // 7)::INTEGER * 7 + 6)::DATE AS week0_e,
               date_trunc('quarter', d + INTERVAL 3 MONTH)::DATE AS quarter1_b,
               last_day(date_trunc('quarter', d - INTERVAL 6 MONTH) + INTERVAL 2 MONTH) AS quarter_2_e,
               date_trunc('year', d + INTERVAL 1 YEAR)::DATE AS year1_b,
               make_date(year(d), 12, 31) AS year0_e,
               (date_trunc('month', d + to_months(CAST(o_orderkey % 5 AS INTEGER))))::DATE AS month_n FROM {DATED}""",
)
def intnx_units(t):
    d = c("d")
    return dated(t).select(
        "o_orderkey",
        sf.intnx("day", d, 10).alias("day10"),
        sf.intnx("week", d, 2).alias("week2_b"),
        sf.intnx("week", d, 0, "e").alias("week0_e"),
        sf.intnx("quarter", d, 1).alias("quarter1_b"),
        sf.intnx("quarter", d, -2, "e").alias("quarter_2_e"),
        sf.intnx("year", d, 1).alias("year1_b"),
        sf.intnx("year", d, 0, "e").alias("year0_e"),
        sf.intnx("month", d, c("o_orderkey") % 5).alias("month_n"),
    )


@query(
    "put_date_formats",
    f"""SELECT o_orderkey, upper(strftime(d, '%d%b%Y')) AS date9, strftime(d, '%m/%d/%y') AS mmddyy8,
               strftime(d, '%m/%d/%Y') AS mmddyy10, strftime(d, '%d/%m/%Y') AS ddmmyy10,
               upper(strftime(d, '%b%y')) AS monyy5, strftime(d, '%b') AS monname3, strftime(d, '%B') AS monname,
               strftime(d, '%Y') AS year4, strftime(d, '%m') AS date_mm FROM {DATED}""",
)
def put_date_formats(t):
    cols = [sf.put(c("d"), f).alias(f.rstrip(".")) for f in sf.FORMATS]
    return dated(t).select("o_orderkey", *cols, sf.substr(sf.put(c("d"), "mmddyy8."), 1, 2).alias("date_mm"))


@query(
    "input_date9",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN d END AS dob,
               CASE WHEN d = DATE '1998-03-23' THEN 1 ELSE 0 END AS is_day FROM {DATED}""",
)
def input_date9(t):
    text = F.when(c("o_orderkey") % 7 == 0, "31FEBnone").when(c("o_orderkey") % 2 == 0, sf.put(c("d"), "date9."))
    text = text.otherwise(F.date_format("d", "ddMMMyyyy"))
    return dated(t).select(
        "o_orderkey", sf.input_(text, "date9.").alias("dob"),
        sf.flag(c("d") == sf.date_literal("23MAR1998")).alias("is_day"),
    )


@query(
    "day_number",
    f"""SELECT o_orderkey, (d - DATE '1960-01-01')::BIGINT AS n, d AS back FROM {DATED}""",
)
def day_number(t):
    n = sf.to_daynum(c("d"))
    return dated(t).select("o_orderkey", n.alias("n"), sf.from_daynum(n).alias("back"))


@query("recent_30_days", f"SELECT o_orderkey, d FROM {DATED} WHERE abs(DATE '2001-07-15' - d) < 30")
def recent_30_days(t):
    return dated(t).where(sf.within_days(c("d"), 30, "2001-07-15")).select("o_orderkey", "d")


@query("last_24_months", f"SELECT o_orderkey, d FROM {DATED} WHERE d >= DATE '1999-09-01'")
def last_24_months(t):
    return dated(t).where(sf.since_months(c("d"), 24, AS_OF)).select("o_orderkey", "d")


@query(
    "maturing_30_days",
    f"""SELECT o_orderkey, e, (e - DATE '2001-09-01')::BIGINT AS days_to_maturity FROM {DATED}
        WHERE e - DATE '2001-09-01' BETWEEN 0 AND 30""",
)
def maturing_30_days(t):
    days = sf.intck("day", sf.today(AS_OF), c("e")).alias("days_to_maturity")
    return dated(t).where(sf.due_within(c("e"), 30, AS_OF)).select("o_orderkey", "e", days)


@query(
    "row_sum_mean",
    """SELECT l_orderkey, l_partkey, l_suppkey,
              CASE WHEN coalesce(a, b, d) IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0) END AS total,
              (coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 1 END)
                + (CASE WHEN b IS NULL THEN 0 ELSE 1 END) + (CASE WHEN d IS NULL THEN 0 ELSE 1 END), 0) AS mean
       FROM (SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN l_quantity END AS a,
                    CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS b,
                    CASE WHEN l_linenumber > 3 THEN l_tax END AS d FROM lineitem)""",
)
def row_sum_mean(t):
    marks = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.when(c("l_quantity") > 25, c("l_quantity")).alias("a"),
        F.when(c("l_returnflag") == "A", c("l_extendedprice")).alias("b"),
        F.when(c("l_linenumber") > 3, c("l_tax")).alias("d"),
    )
    cols = ["a", "b", "d"]
    return marks.select(
        "l_orderkey", "l_partkey", "l_suppkey", sf.row_sum(cols).alias("total"), sf.row_mean(cols).alias("mean")
    )


@query(
    "string_basics",
    """SELECT p_partkey, substr(p_name, 2, 4) AS part_of, length(p_name)::BIGINT AS len, upper(p_brand) AS brand FROM part""",
)
def string_basics(t):
    return t.part.select(
        "p_partkey", sf.substr(c("p_name"), 2, 4).alias("part_of"),
        sf.length(F.concat(c("p_name"), F.lit("   "))).alias("len"), sf.upcase(c("p_brand")).alias("brand"),
    )


@query(
    "substr_overlay",
    """SELECT p_partkey, substr(p_name, 1, 2) || 'M' || substr(p_name, 4) AS one, repeat('M', length(p_name)) AS every,
              CASE WHEN length(p_name) < 9 THEN p_name WHEN length(p_name) = 9 THEN substr(p_name, 1, 8) || 'X'
                   ELSE substr(p_name, 1, 8) || 'XY' || substr(p_name, 11) END AS edge FROM part""",
)
def substr_overlay(t):
    return t.part.select(
        "p_partkey", sf.overwrite(c("p_name"), 3, "MJ").alias("one"), sf.overwrite_all(c("p_name"), "MJ").alias("every"),
        sf.overwrite(c("p_name"), 9, "XYZ", 2).alias("edge"),
    )


@query(
    "char_array",
    "SELECT p_partkey, "
    + ", ".join(f"nullif(substr(p_type, {i}, 1), '') AS c{i}" for i in range(1, 8))
    + " FROM part",
)
def char_array(t):
    cells = sf.chars(c("p_type"), 7)
    return t.part.select("p_partkey", *[F.get(cells, F.lit(i)).alias(f"c{i + 1}") for i in range(7)])


@query(
    "scan_word",
    """SELECT p_partkey, nullif(split_part(p_name, ' ', 1), '') AS w1, nullif(split_part(p_name, ' ', 2), '') AS w2,
              NULL::VARCHAR AS w9, nullif(split_part(p_name, ' ', -1), '') AS last,
              split_part(p_brand, '#', 2) AS brand_no FROM part""",
)
def scan_word(t):
    double = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "  "))
    return t.part.select(
        "p_partkey", sf.scan(double, 1).alias("w1"), sf.scan(double, 2).alias("w2"), sf.scan(double, 9).alias("w9"),
        sf.scan(double, -1).alias("last"), sf.scan(c("p_brand"), 2, "#").alias("brand_no"),
    )


@query(
    "cats_catx",
    """SELECT p_partkey, p_name || coalesce(t, '') || p_size AS joined,
              p_name || coalesce('-' || t, '') || '-' || p_size AS dashed
       FROM (SELECT *, CASE WHEN p_size > 20 THEN p_type END AS t FROM part)""",
)
def cats_catx(t):
    parts = [F.concat(c("p_name"), F.lit("  ")), F.when(c("p_size") > 20, c("p_type")), c("p_size")]
    return t.part.select("p_partkey", sf.cats(*parts).alias("joined"), sf.catx("-", *parts).alias("dashed"))


@query(
    "ifn",
    "SELECT event_id, CASE WHEN CASE WHEN event_type <> 'error' THEN value END > 20 THEN 1 ELSE 2 END AS v FROM events",
)
def ifn(t):
    v = F.when(c("event_type") != "error", c("value"))
    return t.events.select("event_id", sf.ifn(v > 20, 1, 2).alias("v"))


@query(
    "math_basics",
    """SELECT c_custkey, abs(c_acctbal) AS a, trunc(c_acctbal)::BIGINT AS i, ceil(c_acctbal)::BIGINT AS ce,
              round(c_acctbal::DECIMAL(18, 2), 1)::DOUBLE AS r FROM customer""",
)
def math_basics(t):
    b = c("c_acctbal")
    return t.customer.select(
        "c_custkey", F.abs(b).alias("a"), sf.int_(b).alias("i"), F.ceil(b).alias("ce"),
        F.round(b.cast("decimal(18,2)"), 1).cast("double").alias("r"),
    )


@query(
    "eval_division",
    """SELECT o_orderkey, trunc((o_custkey - 700) / nullif(o_orderkey % 4, 0)::DOUBLE)::BIGINT AS c,
              (o_custkey - 700) / nullif(o_orderkey % 4, 0) AS d FROM orders""",
)
def eval_division(t):
    a, b = c("o_custkey") - 700, c("o_orderkey") % 4
    return t.orders.select("o_orderkey", sf.idiv(a, b).alias("c"), sf.fdiv(a, b).alias("d"))


@query(
    "score_band",
    """SELECT l_orderkey, l_partkey, l_suppkey, s,
              CASE WHEN s >= 0.9 THEN 'Ready' WHEN s >= 0.7 THEN 'Review' WHEN s >= 0.5 THEN 'Manual review'
                   ELSE 'Failed' END AS band
       FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity / 50 AS s FROM lineitem)""",
)
def score_band(t):
    scored = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", (c("l_quantity") / 50).alias("s"))
    return scored.withColumn("band", sf.band(c("s")))
