"""URL filtering by mined association rules.

1. A list of host and path rules decides what it covers; the longest rule that fits wins.
2. Labelled urls become sets of tokens (host labels and their words, path words, query keys, digits as ``#``), with
   the label as one more item. FP-growth mines the frequent combinations; rules that conclude ``block`` stay if their
   confidence and support are high enough, also on urls that were held out, and no shorter rule says the same.
3. Each mined rule stands in an inverted index under its rarest token. Distinct token sets meet the rules that are
   listed under one of their tokens, and a rule fires if the set holds all its tokens.

Labels come as a table of urls and verdicts. ``seed_labels`` makes them where there is none: ``block`` if the host has a
word of a lexicon, else a weak ``allow``. Either way only urls that the list leaves open are learnt from, as only such
are judged: what the list decides, it decides by place, and its top-level domains and language paths would become rules.
Without a table of labels, an open url whose host has a lexicon word is blocked even where the word is too rare for a rule.

Nulls: a null url, or one without ``://``, has an empty host and path, no tokens and no rule; it is allowed. Repeated
rows are judged each; token sets are matched once however many pages share them. No labels, or none of a kind: no
mined rule. Very long urls are read whole. Other columns are not carried.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: (host, path prefix, verdict)
LISTED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: host words that label a url as bad where there is no better label; a parameter, of common block list categories
LEXICON = ["adult", "porn", "sex", "xxx", "casino", "poker", "bet", "bets", "betting", "gambling", "pills", "viagra", "pharmacy", "spam", "malware", "phishing", "warez", "torrent", "ads", "adserver", "track", "tracker"]
#: one url in so many, by its hash, is kept from mining and tests the rules
HELD_OUT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> Column:
    """``struct(host, path)``."""
    none = F.struct(F.lit("").alias("host"), F.lit("").alias("path"))

    def of(u: Column) -> Column:
        at = F.instr(u, "://")
        rest = F.substring(u, at + 3, F.length(u))

        def split(r: Column) -> Column:
            host = F.regexp_extract(r, "^[^/?#]*", 0)
            path = F.regexp_extract(F.substring(r, F.length(host) + 1, F.length(r)), "^[^?#]*", 0)
            return F.struct(F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))

        return F.when(at > 0, let(rest, split)).otherwise(none)

    return F.coalesce(let(url, of), none)


def listed(host: Column, path: Column, rules=LISTED) -> Column:
    """``struct(rule, verdict)`` of the longest list rule that fits, else null fields."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: ``h:`` host label of several words, ``w:`` word of a host label, ``p:`` path word, ``q:``
    query key."""
    plain = lambda x: F.regexp_replace(F.translate(x, UPPER, LOWER), "[0-9]+", "#")
    some = lambda xs, mark: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_sort(
        F.array_distinct(
            F.concat(some(F.filter(F.split(plain(host), r"\."), lambda x: x.contains("-")), "h:"), some(F.split(plain(host), r"[.-]"), "w:"), some(F.split(plain(path), "[^a-z#]+"), "p:"), some(F.transform(keys, plain), "q:"))
        )
    )


def judged_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=LISTED) -> DataFrame:
    """``page_id, host, path, rule, listed, tokens, held``; ``held`` urls test the rules instead of being mined."""
    parts = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), url_parts(F.col(url)).alias("parts")).select("page_id", "url", "parts.host", "parts.path")
    found = parts.withColumn("hit", listed(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("listed"), "tokens", (F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0).alias("held"))


def _lexical(lexicon=LEXICON) -> Column:
    return F.arrays_overlap("tokens", F.array(*[F.lit(f"w:{w}") for w in lexicon]))


def seed_labels(judged: DataFrame, lexicon=LEXICON) -> DataFrame:
    """``tokens, held, label`` of the urls that the list leaves open: ``block`` for hosts with a word of the lexicon, else ``allow``."""
    return judged.where("listed IS NULL AND size(tokens) > 0").select("tokens", "held", F.when(_lexical(lexicon), "block").otherwise("allow").alias("label"))


def _outcomes(keyed: DataFrame, labelled: DataFrame) -> DataFrame:
    """``tokens, key, all, bad``: labelled urls, and those to block, that hold all ``tokens`` (listed under ``key``)."""
    alike = labelled.groupBy(F.col("tokens").alias("own"), "label").agg(F.count("*").alias("many"))
    met = alike.withColumn("key", F.explode("own")).join(keyed.select("tokens", "key"), "key").where(F.size(F.array_except("tokens", "own")) == 0)
    return met.groupBy("tokens", "key").agg(F.sum("many").alias("all"), F.sum(F.when(F.col("label") == "block", F.col("many")).otherwise(0)).alias("bad"))


def mine_rules(labelled: DataFrame, support: float = 0.001, confidence: float = 0.95, longest: int = 3, least: int = 3, held: DataFrame | None = None) -> DataFrame:
    """``tokens, confidence, support, key`` of the rules that conclude ``block``, without those a shorter one implies.

    A rule has at most ``longest`` tokens, at least ``least`` urls to block, and ``support`` of all urls to block, so the
    number of frequent tokens, all that FP-growth keeps in one place, is at most the tokens of a url divided by it.
    Single tokens are counted first. A combination with a token that is a rule already says no more, so FP-growth
    gets the other tokens, of the urls to block only, as other combinations cannot conclude ``block``; confidence
    counts all labelled urls, one pass for all candidates by the index. With ``held``, rules must occur and reach the
    confidence there as well.
    """
    spark = labelled.sparkSession
    bad = labelled.where("label = 'block'")
    total = bad.count()
    if not total:
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double, key string")
    need = max(least, support * total)
    sure, often = F.col("bad") / F.col("all"), F.col("bad") / F.lit(float(total))
    good = (sure >= confidence) & (F.col("bad") >= need)
    as_rules = lambda df: df.where(good).select("tokens", sure.alias("confidence"), often.alias("support"), "key")

    def tested(rules: DataFrame) -> DataFrame:
        if held is None:
            return rules
        ok = _outcomes(rules, held).where(sure >= confidence).select("tokens")
        return rules.join(ok, "tokens", "left_semi")

    alone = labelled.select("label", F.explode("tokens").alias("key")).groupBy("key").agg(F.count("*").alias("all"), F.sum((F.col("label") == "block").cast("long")).alias("bad"))
    alone = written(alone.where(F.col("bad") >= need), "url-tokens")
    single = written(tested(as_rules(alone.withColumn("tokens", F.array("key")))), "url-rules")
    # the frequent tokens that are no rule alone: bounded by the support, see above
    left = alone.join(single.select("key"), "key", "left_anti").agg(F.array_sort(F.collect_list("key"))).scalar()
    rows = written(bad.select(F.array_intersect("tokens", left).alias("items")).where("size(items) > 1"), "url-items")
    many = rows.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, need / max(many, 1)), minConfidence=1.0).fit(rows)
    sets = model.freqItemsets.where(F.size("items").between(2, longest)).select(F.array_sort("items").alias("tokens"))
    counts = alone.select("key", F.col("all").alias("count"))
    keyed = sets.withColumn("token", F.explode("tokens")).join(counts, F.col("token") == F.col("key")).groupBy("tokens").agg(F.min(F.struct("count", "key")).alias("rare")).select("tokens", F.col("rare.key").alias("key"))
    several = tested(written(as_rules(_outcomes(written(keyed, "url-sets"), labelled)), "url-rules"))
    rules = written(single.unionByName(several), "url-rules")
    short = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("sure"), F.col("key").alias("token"))
    longer = rules.withColumn("token", F.explode("tokens")).join(short, "token").where((F.size("less") < F.size("tokens")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "tokens")) == 0))
    return rules.join(longer.select("tokens").distinct(), "tokens", "left_anti")


def fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, mined``: for each of the distinct ``tokens``, the surest mined rule that fires (if one does)."""
    index = rules.select("key", F.col("tokens").alias("needs"), "confidence")
    met = sets.withColumn("key", F.explode("tokens")).join(index, "key").where(F.size(F.array_except("needs", "tokens")) == 0)
    return met.groupBy("tokens").agg(F.max(F.struct("confidence", F.array_join("needs", " ").alias("text")))["text"].alias("mined"))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, key: str = "page_id", url: str = "url", rules=LISTED, **how) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for every page; ``labelled`` has ``url, label``."""
    judged = judged_urls(pages, key, url, rules)
    seeded = F.lit(False)
    if labelled is None:
        training, seeded = seed_labels(judged), _lexical()
    else:
        training = judged_urls(labelled.withColumn("page_id", F.col("label")), "page_id", "url", rules).where("listed IS NULL").select("tokens", "held", F.col("page_id").alias("label"))
    found = mine_rules(training.where("NOT held"), held=training.where("held"), **how)
    # written, so that the join below is free to split a token set that very many pages share
    mined = written(fired(judged.where("listed IS NULL").select("tokens").distinct(), found), "url-fired")
    out = judged.join(mined, "tokens", "left")
    bad = F.col("mined").isNotNull() | seeded
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(bad, "block"), F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"))
