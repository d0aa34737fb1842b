"""Delimited files, inline data, text folders and the chunk collection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_KEY = ("filepath", "section_index", "chunk_index")
#: what the reader puts for an unquoted empty field; anything that a field cannot be will do
_NO_TEXT = "\x00missing\x00"


def import_csv(spark: SparkSession, path: str, schema, header: bool = True, sep: str = ",", line_ends: bool | None = None) -> DataFrame:
    """Delimited file with a declared schema; no extra pass to guess types.

    An empty field is missing, a quoted empty one is empty text. A record that does not fit the schema is an error.
    A field may hold line ends, but then a file is one task; large files without are read in parts, by many tasks. Left
    open, ``line_ends`` is looked up first: only a record that goes on has a line with an odd number of quotes.
    """
    if line_ends is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        line_ends = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    # all columns are looked at, whichever are asked for, so that no broken record passes
    return spark.read.option("columnPruning", False).csv(
        path, schema=schema, header=header, sep=sep, escape='"', multiLine=line_ends, mode="FAILFAST",
        nullValue=_NO_TEXT, emptyValue="",
    )


def export(frames: Mapping[str, DataFrame], path: str, fmt: str = "csv") -> list[str]:
    """Each dataset to ``<path>/<name>``; csv with a header, or parquet."""
    written = []
    for name, df in frames.items():
        target = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            # blanks around a field belong to it; a lone carriage return would be read as a line end
            writer.csv(target, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, quoteAll=False)
        else:
            writer.format(fmt).save(target)
        written.append(target)
    return written


def parse_fields(line: Column, schema: T.StructType | str, date_format: str = "ddMMMyyyy", sep: str = " ") -> Column:
    """List input: blank-separated fields of a text line as a struct. A field that cannot be read
    is missing. Repeated blanks count as one."""
    clean = F.trim(F.regexp_replace(line, " +", " ")) if sep == " " else line
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in fields.fields])
    parsed = F.from_csv(clean, raw.toDDL(), {"sep": sep, "mode": "PERMISSIVE"})
    return F.struct(*[_typed(parsed.getField(f.name), f.dataType, date_format).alias(f.name) for f in fields.fields])


def _typed(c: Column, kind: T.DataType, date_format: str) -> Column:
    if isinstance(kind, T.StringType):
        return F.when(c != ".", c)
    if isinstance(kind, T.DateType):
        return F.try_to_date(c, date_format)
    return c.try_cast(kind)


def datalines(spark: SparkSession, text: str, schema: T.StructType | str, date_format: str = "ddMMMyyyy") -> DataFrame:
    """Rows written inside a program, one per line."""
    found = [(i, s.strip()) for i, s in enumerate(text.splitlines()) if s.strip() and s.strip() != ";"]
    lines = spark.createDataFrame(found, "line_no bigint, line string")
    return lines.select(parse_fields(F.col("line"), schema, date_format).alias("r")).select("r.*")


def _suffix_glob(suffixes: Sequence[str]) -> str:
    return "{" + ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def read_texts(spark: SparkSession, path: str, suffixes: Sequence[str] = (".md", ".txt")) -> DataFrame:
    """All text files below a folder as (filepath, text); the suffix is compared without case.

    The suffix filter uses the file path, so files of other kinds are not opened. A file is one row, so it is for
    documents; ``read_text_lines`` takes files of any size.
    """
    return (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=_suffix_glob(suffixes))
        .select(F.col("_metadata.file_path").alias("filepath"), F.col("value").alias("text"))
    )


def read_text_lines(spark: SparkSession, path: str, suffixes: Sequence[str] = (".md", ".txt")) -> DataFrame:
    """All lines of the text files below a folder as (filepath, part, line); for files too large for one row.

    ``part`` is where in the file the reading task began. Files are cut between tasks at line ends, and only
    a newline ends a line. A newline at the end of a file begins no further line.
    """
    return (
        spark.read.text(path, lineSep="\n", recursiveFileLookup=True, pathGlobFilter=_suffix_glob(suffixes))
        .select(F.col("_metadata.file_path").alias("filepath"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("line"))
    )


def save_chunks(df: DataFrame, path: str, rebuild: bool = False) -> DataFrame:
    """Add the documents of ``df`` to the collection at ``path`` (or rebuild it) and return the collection.

    A delivered document replaces all chunks that the collection holds of it, so changed texts and documents that
    became shorter are refreshed. Each call writes only what it delivers, under the next version number; reading
    takes the latest version of each ``filepath`` (a missing one counts as a name of its own). Of rows with the same
    key the one with the smallest text is kept. One writer at a time.
    """
    spark = df.sparkSession
    w = Window.partitionBy(*CHUNK_KEY).orderBy("text", *[c for c in df.columns if c not in (*CHUNK_KEY, "text")])
    fresh = df.withColumn("__no", F.row_number().over(w)).where("__no = 1").drop("__no")
    stored = None if rebuild else _stored(spark, path)
    version = 1 if stored is None else (stored.agg(F.max("__version")).head()[0] or 0) + 1
    numbered = fresh.withColumn("__version", F.lit(version))
    numbered.write.mode("overwrite" if rebuild else "append").partitionBy("__version").parquet(path)
    return read_chunks(spark, path, df.columns)


def read_chunks(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The latest version of every document of a chunk collection."""
    stored = spark.read.parquet(path)
    latest = stored.groupBy("filepath").agg(F.max("__version").alias("__latest")).withColumnRenamed("filepath", "__file")
    same = stored["filepath"].eqNullSafe(latest["__file"]) & (stored["__version"] == latest["__latest"])
    return stored.join(latest, same, "left_semi").select(*(columns or [c for c in stored.columns if c != "__version"]))


def compact_chunks(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Write the latest versions of a chunk collection to the new folder ``to``, as its first version.

    Replaced versions stay behind in ``path``, which is left as it is: readers may still use it. ``to`` must not exist.
    """
    read_chunks(spark, path).withColumn("__version", F.lit(1)).write.partitionBy("__version").parquet(to)
    return read_chunks(spark, to)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
