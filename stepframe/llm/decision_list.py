"""Quality rules: text statistics and a learned decision list, with built-in column functions only.

``text_stats`` computes the statistics of every whole text. ``learn`` grows an ordered list of rules from labelled
rows by sequential covering: a rule is a conjunction of thresholds; conditions are added while they gain
information on the growing part, then the last ones are pruned on the rest while that does not lower the rule's
worth; rows that the rule covers are set aside and the next rule is grown. ``decide`` turns the list into one
ordered conditional expression.

Learning runs on counts: thresholds are quantiles, each labelled row becomes a vector of interval numbers, and
equal vectors are counted once. Each step is one small aggregate over this table; the driver sees sums per feature
and interval, never rows. All labelled rows take part.

Nulls: a null text has no words, lines or symbols. Rows without a label are judged but not learnt from; a null label
counts as none. Several labels of a document: the worst holds. No labels, or none of a kind: an empty list, which
keeps what the base rules keep. Repeated document rows are judged each. Result columns replace columns of the same
name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # fixed values
#: learnt features, from the columns of ``quality_rules``' statistics
FEATURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
}


def _counted(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are among ``letters``."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each counted once."""

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at"))))

        def among(s: Column) -> Column:
            same = lambda k, e: F.coalesce(F.get(s, k)["gram"] == e["gram"], F.lit(False))
            again = F.filter(s, lambda e, k: same(k - 1, e) | same(k + 1, e))
            at = F.sort_array(F.transform(again, lambda e: e["at"]))
            begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
            return F.aggregate(at, begin, lambda a, p: F.struct((p + 3).alias("end"), (a["total"] + (p + 3 - F.greatest(p, a["end"]))).alias("total")))["total"]

        return let(ordered, among)

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(some)

    return of(words)


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``stats``."""
    value = F.coalesce(F.col(text), F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)

        def with_words(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                _counted(t, SYMBOLS).alias("n_symbols"),
                let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
                _repeat_words(w).alias("n_repeat_words"),
                _counted(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
                _counted(t, ".,;:!?").alias("n_marks"),
            )

        return let(F.filter(F.split(t, SPACE), lambda x: x != ""), with_words)

    return docs.withColumn("stats", let(value, of))


BASE = {
    "n_words": "stats.n_words",
    "word_chars": "stats.word_chars",
    "n_symbols": "stats.n_symbols",
    "n_dup_lines": "stats.lines.dup",
    "n_repeat_words": "stats.n_repeat_words",
    "n_lines": "stats.lines.n",
    "n_upper": "stats.n_upper",
    "n_marks": "stats.n_marks",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # above the threshold, else at or below it
    threshold: float
    bin: int  # intervals up to this one are at or below the threshold

    def test(self, features: dict[str, Column]) -> Column:
        return features[self.feature] > F.lit(self.threshold) if self.above else features[self.feature] <= F.lit(self.threshold)

    def on_bins(self) -> Column:
        return F.col(self.feature) > self.bin if self.above else F.col(self.feature) <= self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.on_bins()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information a condition adds for the rows it keeps."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn(
    rows: DataFrame, features: list[str], bad: str = "bad", intervals: int = 24, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, least: int = 5
) -> list[list[Condition]]:
    """Rules that find rows with ``bad`` = 1, from the double columns ``features``.

    A rule stays if, on the pruning third of the rows, at least ``precision`` of what it covers is bad, and it covers
    ``least`` bad rows in all. Which part a row is in follows from its feature values, so equal rows stay together.
    """
    cuts = [i / intervals for i in range(1, intervals)]
    found = rows.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in features]).head()
    thresholds = {f: sorted(set(found[f] or [])) for f in features}
    interval = {f: sum((F.when(F.col(f) > t, 1).otherwise(0) for t in thresholds[f]), F.lit(0)) for f in features}
    part = F.when(F.pmod(F.xxhash64(*features), F.lit(3)) == 0, "prune").otherwise("grow")
    binned = rows.select(part.alias("part"), F.col(bad).cast("int").alias("bad"), *[e.alias(f) for f, e in interval.items()])
    table = written(binned.groupBy(binned.columns).agg(F.count("*").alias("many")), "decision-list")

    def sums(df: DataFrame) -> tuple[int, int]:
        got = df.agg(F.sum(F.when(F.col("bad") == 1, F.col("many"))).alias("p"), F.sum(F.when(F.col("bad") == 0, F.col("many"))).alias("n")).head()
        return got.p or 0, got.n or 0

    rules: list[list[Condition]] = []
    left = table
    while len(rules) < max_rules:
        rule: list[Condition] = []
        p0, n0 = sums(left.where("part = 'grow'"))
        while p0 and n0 and len(rule) < max_conditions:
            best = _best(left.where("part = 'grow'").where(_all(rule)), features, thresholds, p0, n0, least)
            if best is None:
                break
            rule.append(best[0])
            p0, n0 = best[1:]
        if not rule:
            break
        prune = left.where("part = 'prune'")
        worth = []
        for k in range(len(rule), 0, -1):
            p, n = sums(prune.where(_all(rule[:k])))
            worth.append(((p - n) / (p + n) if p + n else -1.0, k, p, n))
        _, k, p, n = max(worth)
        rule = rule[:k]
        if not p + n or p / (p + n) < precision or sums(left.where(_all(rule)))[0] < least:
            break
        rules.append(rule)
        left = left.where(~_all(rule))
    return rules


def _best(df: DataFrame, features: list[str], thresholds: dict[str, list[float]], p0: int, n0: int, least: int) -> tuple[Condition, int, int] | None:
    """The condition with the largest gain: one aggregate per feature and interval."""
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in features])).alias("e")
    counted = df.select("bad", "many", entries).groupBy("e.feature", "e.bin", "bad").agg(F.sum("many").alias("many")).collect()
    best: tuple[float, Condition, int, int] | None = None
    for f in features:
        counts = {(r.bin, r.bad): r.many for r in counted if r.feature == f}
        p = n = 0
        for b, t in enumerate(thresholds[f]):
            p, n = p + counts.get((b, 1), 0), n + counts.get((b, 0), 0)
            for above, x, y in ((True, p0 - p, n0 - n), (False, p, n)):
                if x >= least and (x, y) != (p0, n0):
                    gain = _gain(x, y, p0, n0)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = gain, Condition(f, above, t, b), x, y
    return best[1:] if best else None


def decide(rules: list[list[Condition]], features: dict[str, Column]) -> Column:
    """Text of the first rule that holds, else null: one ordered conditional expression."""
    out = None
    for rule in rules:
        test = rule[0].test(features)
        for c in rule[1:]:
            test = test & c.test(features)
        text = F.lit(" and ".join(map(str, rule)))
        out = F.when(test, text) if out is None else out.when(test, text)
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", **how) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``kept`` and the learnt ``rule`` that rejects, if one does.

    The statistics of all texts are computed once and written to the shared folder; learning and judging read them.
    """
    stats = text_stats(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "stats")
    stats = written(stats, "text-stats").select("doc_id", *[F.col(c).alias(n) for n, c in BASE.items()])
    marks = labels.where(F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(quality) == 0).cast("int").alias("bad"))
    features = {f: F.expr(e) for f, e in FEATURES.items()}
    rows = stats.join(marks, "doc_id").select("bad", *[e.alias(f) for f, e in features.items()])
    rules = learn(rows, list(features), **how)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rule = decide(rules, features)
    out = stats.withColumn("base_failed", failed).withColumn("rule", rule)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
