"""Queries over text scans, chunking and vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

import stepframe as sf

from .registry import query

c = F.col
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "placeholder_scan",
    r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(&[\p{L}\p{N}_]+)', 1))), ',')
               AS found FROM pages""",
)
def placeholder_scan(t):
    return t.pages.select("page_id", F.array_join(sf.placeholders(c("html")), ",").alias("found"))


@query(
    "pattern_count",
    r"""SELECT doc_id, len(regexp_extract_all(text, '(?im)^\s*(?:the|les|und|data|proc|%macro)'))::BIGINT AS blocks
        FROM documents""",
)
def pattern_count(t):
    pattern = r"^\s*(?:the|les|und|data|proc|%macro)"
    return t.documents.select("doc_id", sf.match_count(c("text"), pattern).alias("blocks"))


@query(
    "let_pairs",
    """SELECT p_partkey, 'brand' AS name, p_type AS value FROM part UNION ALL
       SELECT p_partkey, 'size', p_size::VARCHAR FROM part UNION ALL
       SELECT p_partkey, 'label', p_name FROM part WHERE p_size > 10""",
)
def let_pairs(t):
    text = F.concat(
        F.lit("%let brand = "), c("p_brand"), F.lit(";\n%LET size="), c("p_size"), F.lit("; run;\n"),
        F.when(c("p_size") > 10, F.concat(F.lit("%let label =  "), c("p_name"), F.lit(" ;"))).otherwise(""),
        F.lit("%let  brand ="), c("p_type"), F.lit(";"),
    )
    return sf.pairs(t.part.select("p_partkey", text.alias("code")), "p_partkey", "code")


@query(
    "unresolved_names",
    """SELECT p_partkey, CASE WHEN p_size > 10 THEN '&other' ELSE '&Label,&other' END AS found FROM part""",
)
def unresolved_names(t):
    text = F.concat(
        F.lit("%let brand = "), c("p_brand"), F.lit(";\n%LET size="), c("p_size"), F.lit(";\n"),
        F.when(c("p_size") > 10, F.concat(F.lit("%let label =  "), c("p_name"), F.lit(" ;"))).otherwise(""),
        F.lit("x = &Brand. &SIZE &Label &other &other;"),
    )
    return t.part.select("p_partkey", F.array_join(sf.unresolved(text), ",").alias("found"))


@query(
    "marker_lines",
    r"""SELECT doc_id, line, line_no FROM (
          SELECT doc_id, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS line,
                 generate_subscripts(l, 1)::BIGINT AS line_no
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE starts_with(line, 'The')""",
)
def marker_lines(t):
    return sf.marker_lines(t.documents.select("doc_id", "text"), "text", "The")


RULES = [
    (("track(", "gtag"), "script call"),
    (("class=\"ad\"",), "advertisement"),
    (("<table", "<td"), "table"),
    (("lang=\"de\"",), "german"),
]


@query(
    "keyword_tags",
    """SELECT page_id, concat_ws('|',
         CASE WHEN contains(h, 'track(') OR contains(h, 'gtag') THEN 'script call' END,
         CASE WHEN contains(h, 'class="ad"') THEN 'advertisement' END,
         CASE WHEN contains(h, '<table') OR contains(h, '<td') THEN 'table' END,
         CASE WHEN contains(h, 'lang="de"') THEN 'german' END,
         CASE WHEN contains(h, 'first.') OR contains(h, 'last.') THEN 'FIRST LAST retain group by' END,
         CASE WHEN contains(h, 'retain') THEN 'RETAIN running sum cumsum' END,
         CASE WHEN contains(h, 'monotonic') THEN 'monotonic row number reset_index' END,
         CASE WHEN contains(h, 'array') THEN 'ARRAY DO loop iterate columns' END,
         CASE WHEN contains(h, '%macro') OR contains(h, '%do') THEN 'macro DO loop %macro %mend' END,
         CASE WHEN contains(h, 'intnx') OR contains(h, 'intck') THEN 'date function INTNX INTCK interval' END,
         CASE WHEN contains(h, '(select') THEN 'subquery NOT IN anti-join correlated' END) AS tags
       FROM (SELECT page_id, lower(html) AS h FROM pages)""",
)
def keyword_tags(t):
    return t.pages.select("page_id", F.array_join(sf.tag(c("html"), RULES + sf.TAG_RULES), "|").alias("tags"))


@query(
    "query_text",
    f"""SELECT doc_id, {STRIP.format("concat_ws(' ', nullif(lang, ''), CASE WHEN doc_id % 3 <> 0 THEN source END, nullif(substr(text, 1, 50), ''))")}
               AS q FROM documents""",
)
def query_text(t):
    parts = sf.join_parts(c("lang"), F.when(c("doc_id") % 3 != 0, c("source")), F.substring("text", 1, 50))
    return t.documents.select("doc_id", parts.alias("q"))


def sectioned(t):
    text = F.concat(
        c("text"), F.lit("\n---\n## Pattern "), c("doc_id") % 9, F.lit(": "), c("lang"), F.lit(" words \nby "),
        c("source"), F.lit(" and others\n-----\nshort\n---\n"), c("text"),
    )
    return t.documents.select("doc_id", text.alias("text"))


SECTIONED = r"""(SELECT doc_id, section_index, regexp_replace(part, '^\s+|\s+$', '', 'g') AS text FROM (
    SELECT doc_id, unnest(a) AS part, (generate_subscripts(a, 1) - 1)::BIGINT AS section_index FROM (
      SELECT doc_id, regexp_split_to_array(text || chr(10) || '---' || chr(10) || '## Pattern ' || (doc_id % 9) || ': '
        || lang || ' words ' || chr(10) || 'by ' || source || ' and others' || chr(10) || '-----' || chr(10) || 'short'
        || chr(10) || '---' || chr(10) || text, '\n---+\n') AS a FROM documents))
    WHERE length(regexp_replace(part, '^\s+|\s+$', '', 'g')) >= 20)"""


@query("split_sections", f"SELECT doc_id, section_index, text FROM {SECTIONED}")
def split_sections(t):
    return sf.sections(sectioned(t)).drop("pattern_name")


@query(
    "section_header",
    rf"""SELECT doc_id, section_index,
                trim(regexp_extract(text, '##\s+Pattern\s+\d+[.:]?\s*([^\n]*)', 1)) AS pattern_name FROM {SECTIONED}""",
)
def section_header(t):
    return sf.sections(sectioned(t)).drop("text")


def _stop(s: str) -> str:
    win = f"substr(text, {s} + 1, 2048)"
    blank = f"strpos(reverse({win}), chr(10) || chr(10))"
    line = f"strpos(reverse({win}), chr(10))"
    return f"""CASE WHEN {s} + 2048 >= length(text) THEN {s} + 2048
        WHEN {blank} > 0 AND length({win}) - {blank} - 1 > 0 THEN {s} + length({win}) - {blank} - 1
        WHEN {line} > 0 AND length({win}) - {line} > 0 THEN {s} + length({win}) - {line}
        ELSE {s} + 2048 END"""


CHUNKS = rf"""(WITH RECURSIVE w AS (
    SELECT doc_id, source, text, 0::BIGINT AS i, 0::BIGINT AS s, ({_stop("0")})::BIGINT AS e FROM documents
    UNION ALL
    SELECT doc_id, source, text, i + 1, nxt, ({_stop("nxt")})::BIGINT FROM
      (SELECT *, CASE WHEN e - 256 > s THEN e - 256 ELSE e END AS nxt FROM w WHERE e < length(text)))
  SELECT doc_id, source, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS chunk_index, part AS text
  FROM (SELECT doc_id, source, i, regexp_replace(substr(text, s + 1, e - s), '^\s+|\s+$', '', 'g') AS part FROM w)
  WHERE part <> '')"""


@query("size_chunks", f"SELECT doc_id, chunk_index, text FROM {CHUNKS}")
def size_chunks(t):
    return sf.size_chunks(t.documents.select("doc_id", "text"))


@query(
    "window_chunks",
    """SELECT doc_id, i AS chunk_index, substr(text, i * 1792 + 1, 2048) AS text FROM
       (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 256, 1) + 1791) // 1792)) AS i
        FROM documents WHERE length(text) > 0)""",
)
def window_chunks(t):
    return sf.window_chunks(t.documents.select("doc_id", "text"))


@query("chunk_counts", f"SELECT source, count(*) AS chunks FROM {CHUNKS} GROUP BY source")
def chunk_counts(t):
    return sf.chunk_counts(sf.size_chunks(t.documents.select("doc_id", "source", "text")))


PAIRS = """(SELECT a.vec_id AS query_id, b.vec_id AS vector_id,
                   list_sum(list_transform(list_zip(a.embedding, b.embedding),
                            lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d
            FROM embeddings a, embeddings b)"""
HITS = f"""(SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vector_id) AS rank, vector_id, d
            FROM {PAIRS} QUALIFY rank <= 4)"""


def hits(t):
    return sf.nearest(t.embeddings, t.embeddings, query_id="vec_id")


@query("nearest_vectors", f"SELECT query_id, rank, vector_id, round(d, 6) AS distance FROM {HITS}")
def nearest_vectors(t):
    return hits(t).withColumn("distance", F.round("distance", 6))


@query(
    "context_text",
    f"""SELECT query_id, '=== RAG CONTEXT FOR CODE GEN ===' || chr(10) || chr(10) || 'Block type: ' || label || chr(10)
          || 'Relevant patterns retrieved: ' || count(*) || chr(10) || chr(10)
          || string_agg('Pattern ' || rank || ' (from ' || source || ')' || CASE WHEN lang <> 'en' THEN ': ' || lang ELSE '' END
                        || chr(10) || {STRIP.format("text")} || chr(10), chr(10) ORDER BY rank)
          || chr(10) || '=== END RAG CONTEXT ===' AS context
        FROM {HITS} JOIN documents ON vector_id = doc_id
        JOIN (SELECT vec_id, 'k' || label AS label FROM embeddings) ON query_id = vec_id
        GROUP BY query_id, label""",
)
def context_text(t):
    docs = t.documents.select(
        c("doc_id").alias("vector_id"), "source", "text", F.nullif(c("lang"), F.lit("en")).alias("pattern_name")
    )
    kinds = t.embeddings.select(c("vec_id").alias("query_id"), F.concat(F.lit("k"), c("label")).alias("kind"))
    found = hits(t).join(docs, "vector_id").join(kinds, "query_id")
    return sf.context(found, "query_id", "kind")


@query(
    "retrieval_fallback",
    """SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS is_fallback,
              CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality
                   WHEN d.lang = 'en' THEN 'Read the original.' WHEN d.lang = 'fr' THEN 'Translate first.'
                   ELSE 'No specific guidance available.' END AS text
       FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang <> 'de'""",
)
def retrieval_fallback(t):
    found = t.labels.select("doc_id", F.concat(F.lit("quality "), c("quality")).alias("text"))
    defaults = {"en": "Read the original.", "fr": "Translate first."}
    return sf.with_fallback(found, t.documents, "doc_id", "lang", defaults, skipped=("de",))


@query(
    "fallback_context",
    """SELECT doc_id, '=== RAG CONTEXT FOR CODE GEN ===' || chr(10) || chr(10) || 'Block type: ' || lang || chr(10)
         || 'No specific pattern found in knowledge base.' || chr(10) || chr(10) || 'Fallback guidance:' || chr(10)
         || 'No specific guidance available.' || chr(10) || chr(10) || '=== END RAG CONTEXT ===' AS context
       FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def fallback_context(t):
    alone = sf.not_in(t.documents.select("doc_id", "lang"), t.labels, "doc_id")
    guidance = F.lit("No specific guidance available.")
    return alone.select("doc_id", sf.fallback_text(c("lang"), guidance).alias("context"))
