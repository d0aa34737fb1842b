"""Calendar intervals, date shifting, date text, day numbers.

Every function that depends on the current day takes ``as_of``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: day 0 of the day-number scale
DAY_ZERO = dt.date(1960, 1, 1)
#: a Sunday; weeks run Sunday to Saturday
_SUNDAY = dt.date(1959, 12, 27)

# Date format name -> (Spark pattern, upper case).
FORMATS = {
    "date9.": ("ddMMMyyyy", True),
    "mmddyy8.": ("MM/dd/yy", False),
    "mmddyy10.": ("MM/dd/yyyy", False),
    "ddmmyy10.": ("dd/MM/yyyy", False),
    "monyy5.": ("MMMyy", True),
    "monname3.": ("MMM", False),
    "monname.": ("MMMM", False),
    "year4.": ("yyyy", False),
}

_UNITS = ("day", "week", "month", "quarter", "year")
_ALIGN = {"b": "b", "beginning": "b", "e": "e", "end": "e", "m": "m", "middle": "m",
          "s": "s", "same": "s", "sameday": "s"}


def _unit(unit: str) -> str:
    u = unit.lower()
    u = u[:-1] if u.endswith("s") else u
    if u not in _UNITS:
        raise ValueError(f"unknown interval {unit!r}; known: {_UNITS}")
    return u


def _date(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("date")


def today(as_of=None) -> Column:
    return F.current_date() if as_of is None else _date(as_of)


def year(c: Column) -> Column:
    return F.year(c).cast("bigint")


def month(c: Column) -> Column:
    return F.month(c).cast("bigint")


def day(c: Column) -> Column:
    return F.dayofmonth(c).cast("bigint")


def _months(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def _week_no(c: Column) -> Column:
    return F.floor(F.datediff(c, F.lit(_SUNDAY)) / F.lit(7))


def intck(unit: str, a, b, how: str = "boundary") -> Column:
    """Intervals between two dates.

    ``boundary`` counts calendar boundaries crossed (Dec 31 to Jan 1 is one year); ``continuous``
    counts complete intervals since the start date (age in years); ``elapsed`` divides days by 7
    for weeks and months by 3 for quarters, rounding down.
    """
    u, a, b = _unit(unit), _date(a), _date(b)
    days, months = F.datediff(b, a), _months(a, b)
    if how == "boundary":
        out = {
            "day": days,
            "week": _week_no(b) - _week_no(a),
            "month": months,
            "quarter": (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a),
            "year": F.year(b) - F.year(a),
        }[u]
    elif how == "elapsed":
        out = {
            "day": days,
            "week": F.floor(days / F.lit(7)),
            "month": months,
            "quarter": F.floor(months / F.lit(3)),
            "year": F.year(b) - F.year(a),
        }[u]
    elif how == "continuous":
        full = months - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
        short = (F.month(b) < F.month(a)) | ((F.month(b) == F.month(a)) & (F.dayofmonth(b) < F.dayofmonth(a)))
        out = {
            "day": days,
            "week": F.floor(days / F.lit(7)),
            "month": full,
            "quarter": F.floor(full / F.lit(3)),
            "year": F.year(b) - F.year(a) - F.when(short, 1).otherwise(0),
        }[u]
    else:
        raise ValueError("how must be 'boundary', 'continuous' or 'elapsed'")
    return out.cast("bigint")


def age(birth: Column, as_of=None) -> Column:
    """Complete years."""
    return intck("year", birth, today(as_of), how="continuous")


def intnx(unit: str, d, n=0, align: str = "b") -> Column:
    """Shift a date by ``n`` intervals, then align it to the begin, middle, end or same day.

    The shift clamps to the end of a shorter month. The middle of a month is its 15th day; the
    middle of other intervals is the day half-way between begin and end.
    """
    u, d = _unit(unit), _date(d)
    n = n.cast("int") if isinstance(n, Column) else F.lit(int(n))
    if align.lower() not in _ALIGN:
        raise ValueError(f"unknown alignment {align!r}")
    to = _ALIGN[align.lower()]
    if u == "day":
        return F.date_add(d, n)
    if u == "week":
        moved = F.date_add(d, n * 7)
        if to == "s":
            return moved
        sunday = F.date_sub(moved, F.dayofweek(moved) - 1)
        return F.date_add(sunday, {"b": 0, "m": 3, "e": 6}[to])
    size = {"month": 1, "quarter": 3, "year": 12}[u]
    moved = F.add_months(d, n * size)
    if to == "s":
        return moved
    begin = F.trunc(moved, u)
    if to == "b":
        return begin
    if u == "month" and to == "m":
        return F.date_add(begin, 14)
    end = F.date_sub(F.add_months(begin, size), 1)
    if to == "e":
        return end
    return F.date_add(begin, F.floor(F.datediff(end, begin) / F.lit(2)).cast("int"))


def put(c: Column, fmt: str) -> Column:
    """Date as text in a named format."""
    pattern, upper = FORMATS[fmt.lower()]
    text = F.date_format(_date(c), pattern)
    return F.upper(text) if upper else text


def input_(c: Column, fmt: str) -> Column:
    """Text in a named format as date; text that does not fit gives missing."""
    name = fmt.lower()
    if name not in ("date9.", "mmddyy8.", "mmddyy10.", "ddmmyy10."):
        raise ValueError(f"{fmt!r} does not hold a full date")
    return F.try_to_date(c, FORMATS[name][0])


def date_literal(text: str) -> Column:
    """``'23MAR2023'`` as a date constant."""
    return F.lit(dt.datetime.strptime(text.title(), "%d%b%Y").date())


def from_daynum(n: Column) -> Column:
    """Days since 1960-01-01 to date."""
    return F.date_add(F.lit(DAY_ZERO), n.cast("int"))


def to_daynum(c: Column) -> Column:
    return F.datediff(_date(c), F.lit(DAY_ZERO)).cast("bigint")


def within_days(c: Column, n: int, as_of=None) -> Column:
    """Fewer than ``n`` days from the reference day, before or after it."""
    return F.abs(F.datediff(today(as_of), _date(c))) < n


def since_months(c: Column, n: int, as_of=None) -> Column:
    """On or after the first day of the month ``n`` months before the reference day."""
    return _date(c) >= intnx("month", today(as_of), -n, "b")


def due_within(c: Column, n: int, as_of=None) -> Column:
    """From the reference day up to ``n`` days after it."""
    return F.datediff(_date(c), today(as_of)).between(0, n)
