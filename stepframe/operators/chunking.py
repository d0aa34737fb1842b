"""Text tables to chunk tables: sections, size-bounded chunks, fixed windows."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textscan import raw_lines, strip
from .spread import fan_out

# Chunk length and overlap in characters, shortest section kept.
CHUNK_SIZE = 2048
CHUNK_OVERLAP = 256
MIN_SECTION = 20
# The line between sections, the heading of a section.
SECTION_LINE = r"\n---+\n"
HEADING = r"##\s+Pattern\s+\d+[.:]?\s*([^\n]*)"


def sections(df: DataFrame, text: str = "text", min_chars: int = MIN_SECTION) -> DataFrame:
    """Split on lines of three or more dashes; strip; drop short sections, keep their index.

    Adds ``section_index``, ``pattern_name`` (empty when there is no heading) and replaces ``text``.
    """
    rows = df.select(
        *[c for c in df.columns if c != text],
        F.posexplode(F.split(F.col(text), SECTION_LINE)).alias("__pos", "__part"),
    )
    out = rows.withColumn("__part", strip(F.col("__part"))).where(F.length("__part") >= min_chars)
    return out.select(
        *[c for c in df.columns if c != text],
        F.col("__pos").cast("bigint").alias("section_index"),
        strip(F.regexp_extract(F.col("__part"), HEADING, 1)).alias("pattern_name"),
        F.col("__part").alias(text),
    )


class _Breaks:
    """All places of a text where one kind of break begins, in order."""

    def __init__(self, text: str, mark: str):
        self.width = len(mark)
        self.places = [m.start() for m in re.finditer(f"(?={re.escape(mark)})", text)]

    def last(self, after: int, until: int) -> int | None:
        """The last one that begins after ``after`` and is over by ``until``."""
        k = bisect.bisect_right(self.places, until - self.width) - 1
        return self.places[k] if k >= 0 and self.places[k] > after else None


def _pieces(text: str, size: int, overlap: int, keep_tail: bool) -> Iterator[slice]:
    """Stretches of at most ``size`` characters that end at the best break inside."""
    kinds = [_Breaks(text, mark) for mark in ("\n\n", "\n")]
    piece = slice(0, 0)
    while keep_tail or not text or piece.stop < len(text):
        # the overlap is given up where it would not move forward
        begin = piece.stop - overlap if piece.stop - overlap > piece.start else piece.stop
        if begin >= len(text):
            return
        limit = begin + size
        found = (b.last(begin, limit) for b in kinds) if limit < len(text) else ()
        piece = slice(begin, next((p for p in found if p is not None), limit))
        yield piece


def _chunks_of(text: str, size: int, overlap: int, keep_tail: bool) -> list[str]:
    return [c for c in (text[p].strip() for p in _pieces(text, size, overlap, keep_tail)) if c]


def size_chunks(
    df: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    keep_tail: bool = False,
) -> DataFrame:
    """Chunks of at most ``size`` characters, cut at the last blank line, else the last newline,
    else hard; each starts ``overlap`` characters before the end of the one before.

    The next start falls back to the end of the last chunk when the overlap would not move forward.
    Chunking ends once the text is covered; ``keep_tail=True`` adds the short repeat of the last
    characters that an overlap past the end of the text gives. Adds ``chunk_index``.
    """

    # row by row: Arrow batches of thousands of long texts, and all their chunks, would stand in a Python worker at once
    @F.udf("array<string>", useArrow=False)
    def split(t: str | None) -> list[str] | None:
        return None if t is None else _chunks_of(t, size, overlap, keep_tail)

    # one pass: the Python worker sees long texts only, a short text is one chunk as it is
    rows = fan_out(df).withColumn("__long", split(F.when(F.length(text) > size, F.col(text))))
    short = F.filter(F.array(strip(F.col(text))), lambda c: c != "")
    rows = rows.withColumn("__chunks", F.when(F.length(text) > size, F.col("__long")).otherwise(short))
    return rows.select(
        *[c for c in df.columns if c != text],
        F.posexplode("__chunks").alias("__pos", text),
    ).withColumn("chunk_index", F.col("__pos").cast("bigint")).drop("__pos")


def window_chunks(
    df: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Fixed windows of ``size`` characters every ``size - overlap`` characters. Adds ``chunk_index``."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(size - overlap))
    rows = df.where(F.length(text) > 0).select("*", F.posexplode(starts).alias("__pos", "__start"))
    return (
        rows.withColumn(text, F.substr(F.col(text), F.col("__start"), F.lit(size)))
        .withColumn("chunk_index", F.col("__pos").cast("bigint"))
        .drop("__pos", "__start")
    )


def document_chunks(df: DataFrame, filepath: str = "filepath", text: str = "text") -> DataFrame:
    """Documents to the chunk table (source, filepath, pattern_name, section_index, chunk_index, text)."""
    named = df.select(
        F.element_at(F.split(F.col(filepath), "/"), -1).alias("source"),
        F.col(filepath).alias("filepath"),
        F.col(text).alias("text"),
    )
    out = size_chunks(sections(named))
    return out.select("source", "filepath", "pattern_name", "section_index", "chunk_index", "text")


def chunk_counts(chunks: DataFrame, by: str = "source", name: str = "chunks") -> DataFrame:
    """Chunks per source."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def line_marks(df: DataFrame, text: str, comment: str, skip: str, mark: str) -> DataFrame:
    """Replace ``text`` by ``total`` and ``missing``: substantive lines, and those without a mark.

    A line is substantive when it is not blank, does not start with ``comment`` and does not match
    ``skip``. It is marked when it contains ``mark``, or when the first non-blank of the next two
    lines starts with ``mark``. Each line meets its successors by zipping the line array with
    itself, shifted; nothing is exploded or shuffled.
    """
    rest = [c for c in df.columns if c != text]
    split = df.select(*rest, raw_lines(F.col(text)).alias("__raw"))
    both = split.withColumn("__s", F.transform("__raw", lambda x: strip(x)))
    none = F.array(F.lit(""), F.lit(""))
    near = F.arrays_zip(
        F.col("__raw").alias("raw"),
        F.col("__s").alias("s"),
        F.slice(F.concat("__s", none), F.lit(2), F.size("__s")).alias("n1"),
        F.slice(F.concat("__s", none), F.lit(3), F.size("__s")).alias("n2"),
    )

    def judge(x: Column) -> Column:
        s, n1, n2 = x.getField("s"), x.getField("n1"), x.getField("n2")
        real = (s != "") & ~s.startswith(comment) & ~s.rlike(skip)
        marked = x.getField("raw").contains(mark) | F.when(n1 != "", n1).otherwise(n2).startswith(mark)
        return F.when(real, F.when(marked, 0).otherwise(1)).otherwise(-1)

    judged = both.select(*rest, F.transform(near, judge).alias("__v"))
    return judged.select(
        *rest,
        F.size(F.filter("__v", lambda v: v >= 0)).cast("bigint").alias("total"),
        F.size(F.filter("__v", lambda v: v == 1)).cast("bigint").alias("missing"),
    )
