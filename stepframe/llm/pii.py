"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them.

Base spans (email, ip, card, phone) are found by patterns, kept if they pass their checks, and are the protected
entities. Around each entity the words of its context are candidate terms. Over all documents, how strongly term t
reveals entity e is PMI(e; t) / IC(e) = log(p(e|t) / p(e)) / -log p(e): 1 if every document with t has e next to it,
0 if t says nothing. A term that reveals an entity more than ``disclosure``, in at least ``contexts`` different
contexts, is a span of kind ``term`` in the documents that hold both. Spans are generalised to their kind or removed.

Only built-in column functions are used. Copies of a text are one row with a count, so a text that a third of all
documents repeat is one context. Entities, terms and counts stay distributed; pair counts combine before they move.

The patterns are written so that no text makes them slow: repeated classes are possessive where nothing can be given
back, and a match starts only where its run starts.

Nulls: a null text has no spans and stays null. Empty and very long texts are read like others. A null ``doc_id`` is
kept. Repeated rows are judged each. An empty table gives an empty result. Result columns replace columns of the same
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, back, let, written

KINDS = ["email", "ip", "card", "phone", "term"]
_LOCAL = r"A-Za-z0-9._%+-"
#: a run's start, or where the last match ended
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without it has no base span of the kind
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: words on either side of an entity that are its context, and letters read to find them
CONTEXT_WORDS, CONTEXT_CHARS = 8, 160


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def of(d: Column) -> Column:
        def value(i: Column) -> Column:
            v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return v - F.when(v > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0

    return let(digits, of)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def spans_of(text: Column, pattern: Column, kind: int, check=lambda m: F.lit(True)) -> Column:
    """Leftmost matches that do not overlap, as ``struct(start, kind, end)`` in code points, end exclusive."""
    pieces = F.split(text, pattern, -1)
    found = let(pieces, lambda p: F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m, i: F.struct(F.length(F.get(p, i)).alias("gap"), F.length(m).alias("size"), check(m).alias("good"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(now: Column, m: Column) -> Column:
        start = now["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["size"]).alias("end"))
        return F.struct((start + m["size"]).alias("at"), F.when(m["good"], F.concat(now["spans"], F.array(span))).otherwise(now["spans"]).alias("spans"))

    return F.aggregate(found, begin, step)["spans"]


def base_spans(text: Column) -> Column:
    """All base spans of a text (not null), by start, then kind."""
    none = F.array().cast(SPAN)

    def of(t: Column) -> Column:
        each = [F.when(t.rlike(NEEDS[k]), spans_of(t, F.lit(PATTERNS[k]), KINDS.index(k), CHECKS[k])).otherwise(none) for k in PATTERNS]
        return F.when(t.rlike("[@0-9]"), F.sort_array(F.concat(*each))).otherwise(none)

    return let(text, of)


def _context(text: Column, span: Column) -> Column:
    """Words before and after a span, nearest ones first on either side, lower case, whole words only."""
    before = F.substring(text, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT_CHARS)))
    after = F.substring(text, span["end"] + 1, F.lit(CONTEXT_CHARS))
    words = lambda x: F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # the outermost word of each side may be cut and is left out; words that touch the entity are part of it
    left = F.reverse(words(F.regexp_replace(F.regexp_replace(before, r"^[\p{L}\p{N}]+", ""), r"[\p{L}\p{N}]+$", "")))
    right = words(F.regexp_replace(F.regexp_replace(after, r"[\p{L}\p{N}]+$", ""), r"^[\p{L}\p{N}]+", ""))
    return F.concat(F.slice(left, 1, CONTEXT_WORDS), F.slice(right, 1, CONTEXT_WORDS))


def disclosing_terms(docs: DataFrame, text: str = "text", disclosure: float = 0.9, contexts: int = 3) -> tuple[DataFrame, DataFrame] | None:
    """Terms per text: ``text_hash, terms``, and the table ``entity, term, strength``; None if no term reveals any."""
    value = F.coalesce(F.col(text), F.lit(""))
    marked = docs.where(value.rlike("[@0-9]")).select(F.xxhash64(value).alias("text_hash"), value.alias("text"), base_spans(value).alias("base")).where(F.size("base") > 0)
    each = marked.select("text_hash", F.explode(F.transform("base", lambda s: F.struct(F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(F.substring("text", s["start"] + 1, s["end"] - s["start"]))).alias("entity"), _context(F.col("text"), s).alias("words")))).alias("c"))
    rows = each.select("text_hash", "c.entity", F.xxhash64("c.words").alias("context"), F.explode(F.array_distinct("c.words")).alias("term")).where("length(term) > 2")
    # copies of a text fall together here, before anything else is counted
    rows = written(rows.groupBy("entity", "term", "text_hash", "context").agg(F.count("*").alias("rows")), "pii-contexts")
    wide = rows.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= contexts)
    per_text = rows.groupBy("entity", "term", "text_hash").agg(F.max("rows").alias("rows"))
    pairs = written(per_text.join(wide, ["entity", "term"]).groupBy("entity", "term").agg(F.sum("rows").alias("both")), "pii-pairs")
    if pairs.isEmpty():
        return None
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(value), r"[^\p{L}\p{N}]+"))).alias("term")).where("length(term) > 2")
    # an inner join, as a semi join would be moved below the count, onto every word of the corpus
    terms = words.groupBy("term").agg(F.count("*").alias("having")).join(pairs.select("term").distinct(), "term")
    holders = rows.select("entity", "text_hash", "rows", "context").groupBy("entity", "text_hash").agg(F.max("rows").alias("rows")).groupBy("entity").agg(F.sum("rows").alias("holding"))
    total = docs.count()
    chance = F.col("holding") / F.lit(float(total))
    given = F.least(F.col("both") / F.col("having"), F.lit(1.0))
    strength = F.when(chance >= 1, 0.0).otherwise(F.log(given / chance) / -F.log(chance))
    strong = pairs.join(terms, "term").join(holders, "entity").withColumn("strength", strength).where(F.col("strength") >= disclosure).select("entity", "term", "strength")
    strong = written(strong, "pii-strong")
    if strong.isEmpty():
        return None
    per_text = rows.join(strong, ["entity", "term"]).groupBy("text_hash").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return per_text, strong


def _with_terms(base: Column, text: Column, terms: Column) -> Column:
    """Base spans and the spans of the terms that do not touch them."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    extra = F.filter(spans_of(text, pattern, KINDS.index("term")), lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    return F.when(terms.isNull(), base).otherwise(F.sort_array(F.concat(base, extra)))


def find_pii(docs: DataFrame, text: str = "text", disclosure: float = 0.9, contexts: int = 3) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of ``struct(start, kind, end)``; ``kind`` numbers ``KINDS``."""
    value = F.coalesce(F.col(text), F.lit(""))
    found = disclosing_terms(docs, text, disclosure, contexts)
    out = docs.withColumn("base", base_spans(value))
    if found is None:
        return out.withColumn("spans", F.col("base"))
    own, to = aside(out, "text_hash", "terms")
    own = own.withColumn("text_hash", F.xxhash64(value)).join(found[0], "text_hash", "left").withColumn("spans", _with_terms(F.col("base"), value, F.col("terms")))
    return back(own, [*[c for c in out.columns if c.lower() != "spans"], "spans"], to)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column, generalise: bool = True) -> Column:
    """``text`` with each span replaced by ``[KIND]`` (overlapping ones by the first's) or removed."""
    names = F.array(*[F.lit(f"[{k.upper()}]" if generalise else "") for k in KINDS])

    def of(t: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(now: Column, s: Column) -> Column:
            gap = F.substring(t, now["at"] + 1, s["start"] - now["at"])
            parts = F.when(s["start"] >= now["at"], F.concat(now["parts"], F.array(gap, F.get(names, s["kind"])))).otherwise(now["parts"])
            return F.struct(F.greatest(now["at"], s["end"]).alias("at"), parts.alias("parts"))

        return let(F.aggregate(spans, begin, step), lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(t, d["at"] + 1, F.length(t))))

    return F.when(F.size(spans) > 0, let(text, of)).otherwise(text)


def sanitise(docs: DataFrame, text: str = "text", generalise: bool = True, chars: str | None = None, **how) -> DataFrame:
    """All documents, with their spans generalised or removed; columns of ``docs``. ``chars`` counts the text's letters
    and follows where the text changes."""
    own, to = aside(docs, "base", "spans")
    found = find_pii(own, text, **how).withColumn(text, sanitised(F.col(text), F.col("spans"), generalise))
    if chars:
        found = found.withColumn(chars, F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col(chars)).cast(docs.schema[chars].dataType))
    return back(found, docs.columns, to)
