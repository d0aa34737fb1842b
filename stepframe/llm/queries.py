"""Registered queries of the corpus operators: each applies one to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decision_list, decontaminate, lexical_search, licenses, packing, periodic_runs, pii, quality_lm, simhash, suffix_dedup, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: name of the tokenizer file for packing
TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op1_suffix_dedup")
def op1(spark: SparkSession, base: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, base, "documents").select("doc_id", "text")).drop("kept")


@query("op2_quality_perplexity")
def op2(spark: SparkSession, base: str) -> DataFrame:
    return quality_lm.quality_scores(table(spark, base, "documents"), table(spark, base, "labels")).drop("text_hash")


@query("op3_url_rules")
def op3(spark: SparkSession, base: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, base, "pages"))


@query("op4_personal_data")
def op4(spark: SparkSession, base: str) -> DataFrame:
    found = pii.find_pii(table(spark, base, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query("op5_benchmark_hits")
def op5(spark: SparkSession, base: str) -> DataFrame:
    found = decontaminate.benchmark_hits(table(spark, base, "documents").select("doc_id", "text"), table(spark, base, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query("op6_simhash_components")
def op6(spark: SparkSession, base: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, base, "documents").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op7_quality_rules")
def op7(spark: SparkSession, base: str) -> DataFrame:
    return decision_list.quality_rules(table(spark, base, "documents"), table(spark, base, "labels"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack_documents(table(spark, base, "documents"), tokenizer_path())


@query("op9_chat_format")
def op9(spark: SparkSession, base: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, base, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.format_chats(rows.unionByName(extra)))


@query("op10_license_scan")
def op10(spark: SparkSession, base: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, base, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.array_join(F.transform("licenses", lambda x: x["kind"]), ",").alias("kinds"),
        F.array_join("open_ids", ",").alias("open_ids"),
    )


@query(
    "op11_lexical_search",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
        t AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
        p AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
        f AS (SELECT doc_id, n, term, count(*) AS tf FROM p SEMI JOIN q USING (term) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * t.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, t GROUP BY term, t.n),
        s AS (SELECT item_id, doc_id,
                     sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * f.n * t.n) // t.l))))::BIGINT AS score
              FROM q JOIN f USING (term) JOIN w USING (term), t GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
              FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
)
def op11(spark: SparkSession, base: str) -> DataFrame:
    return lexical_search.search(table(spark, base, "benchmark"), table(spark, base, "documents").select("doc_id", "text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, base: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, base, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten, by its id's checksum, goes on repeating a stretch of words to its end (as the contract of op12 says)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    parts = docs.withColumns({"h": h, "g": F.floor(h / 10), "words": words}).withColumn("n", F.size("words"))
    parts = parts.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    parts = parts.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.expr("slice(words, a + 1, p)"), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.expr("slice(words, 1, a)"), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return parts.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op13_toxicity")
def op13(spark: SparkSession, base: str) -> DataFrame:
    docs, labels = table(spark, base, "documents").select("doc_id", "text"), table(spark, base, "labels").select("doc_id", "toxic")
    held_out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
