"""Scans of a text column for placeholders, patterns, definitions and marked lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a name, white space, line ends.
WORD = r"[\p{L}\p{N}_]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def placeholders(c: Column) -> Column:
    """Distinct ``&name`` references in the text, sorted."""
    found = F.regexp_extract_all(c, F.lit(f"(&{WORD}+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def match_count(c: Column, pattern: str, ignore_case: bool = True, multiline: bool = True) -> Column:
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    return F.regexp_count(c, F.lit(f"(?{flags}){pattern}" if flags else pattern)).cast("bigint")


def _definition(keyword: str) -> str:
    # Fixed value: how a text defines a name.
    return rf"(?i){keyword}\s+({WORD}+)\s*=\s*([^;]+);"


def unresolved(c: Column, keyword: str = "%let") -> Column:
    """Placeholders that the text itself does not define, sorted; case is ignored."""
    defined = F.transform(F.regexp_extract_all(c, F.lit(_definition(keyword)), F.lit(1)), lambda x: F.concat(F.lit("&"), F.lower(x)))
    # the one-entry array binds the definitions once
    return F.get(F.transform(F.array(defined), lambda d: F.filter(placeholders(c), lambda x: ~F.array_contains(d, F.lower(x)))), F.lit(0))


def pairs(df: DataFrame, key, c: str, keyword: str = "%let") -> DataFrame:
    """``%let name = value;`` definitions as rows (key, name, value); the last one wins.

    A name occurs once per text and round of ``max_by``, so only (key, name) groups are shuffled.
    """
    pattern = _definition(keyword)
    names = F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(2))
    rows = df.select(key, F.posexplode(F.arrays_zip(names.alias("n"), values.alias("v"))).alias("pos", "d"))
    return rows.groupBy(key, F.col("d.n").alias("name")).agg(F.trim(F.max_by("d.v", "pos")).alias("value"))


def raw_lines(c: Column) -> Column:
    """The text split at line ends; a final line end leaves an empty last entry."""
    return F.split(c, LINE_ENDS)


def lines(c: Column) -> Column:
    """The text as an array of lines; a final line end does not start another line."""
    # the one-entry array binds the split once
    return F.get(
        F.transform(
            F.array(raw_lines(c)),
            lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
        ),
        F.lit(0),
    )


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.btrim(c, F.lit(SPACES))


def marker_lines(df: DataFrame, c: str, prefix: str, name: str = "line") -> DataFrame:
    """Stripped lines that start with ``prefix``, with their 1-based line number."""
    rows = df.select("*", F.posexplode(raw_lines(F.col(c))).alias("__pos", "__line"))
    kept = rows.withColumn(name, strip(F.col("__line"))).where(F.col(name).startswith(prefix))
    return kept.withColumn("line_no", (F.col("__pos") + 1).cast("bigint")).drop(c, "__pos", "__line")


def tag(c: Column, rules: Mapping[str, str] | list[tuple[tuple[str, ...], str]]) -> Column:
    """Hints whose markers occur in the text, case ignored, in the order of the rules."""
    items = rules.items() if isinstance(rules, Mapping) else rules
    low = F.lower(c)

    def any_of(markers) -> Column:
        markers = (markers,) if isinstance(markers, str) else markers
        cond = None
        for m in markers:
            hit = low.contains(m)
            cond = hit if cond is None else cond | hit
        return cond

    return F.array_compact(F.array(*[F.when(any_of(m), hint) for m, hint in items]))


# Markers in a program text and the search words they add to a query.
TAG_RULES = [
    (("first.", "last."), "FIRST LAST retain group by"),
    (("retain",), "RETAIN running sum cumsum"),
    (("monotonic",), "monotonic row number reset_index"),
    (("array",), "ARRAY DO loop iterate columns"),
    (("%macro", "%do"), "macro DO loop %macro %mend"),
    (("intnx", "intck"), "date function INTNX INTCK interval"),
    (("(select",), "subquery NOT IN anti-join correlated"),
]
