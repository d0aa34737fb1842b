"""Exact top-k vector search, fallback texts, assembled context."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textscan import strip
from .metric_index import tiles

# Fixed value: hits per query.
TOP_K = 4

# Text around assembled context.
CONTEXT_HEAD = "=== RAG CONTEXT FOR CODE GEN ==="
CONTEXT_TAIL = "=== END RAG CONTEXT ==="
NO_GUIDANCE = "No specific guidance available."
NOT_FOUND = "No specific pattern found in knowledge base."
SKIPPED_TYPES = ("macro", "unknown")


def _picked(df: DataFrame, key: str, embedding: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(embedding).alias("v")).where("v IS NOT NULL")


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors for every query vector: (query_id, rank, vector_id, distance).

    Squared Euclidean distance in double precision; equal distances go to the smaller id. Vectors are indexed by their
    nearest pivot and queries travel only to blocks that can hold one of their hits (see ``metric_index``); a block
    emits k rows per query and the last step merges these. No side is collected or shipped whole. Equal query rows
    count once.
    """
    q = _picked(queries, query_id, embedding).distinct()
    found = tiles(q, _picked(vectors, vector_id, embedding), k)
    if found is None:
        kinds = (queries.schema[query_id].dataType.simpleString(), vectors.schema[vector_id].dataType.simpleString())
        found = queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, vector_id {kinds[1]}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vector_id")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("bigint").alias("rank"), "vector_id", "distance")
    )


def pairs_measured(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = TOP_K,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """One row (measured, pairs): pairs that ``nearest`` measures, and all pairs of a query and a vector."""
    q, v = _picked(queries, query_id, embedding).distinct(), _picked(vectors, vector_id, embedding)
    found = tiles(q, v, k, count=True)
    measured = F.lit(0).cast("bigint") if found is None else found.agg(F.coalesce(F.sum("measured"), F.lit(0))).scalar()
    counts = q.agg(F.count(F.lit(1)).alias("__q")).withColumn("__v", v.agg(F.count(F.lit(1))).scalar())
    return counts.select(measured.alias("measured"), (F.col("__q") * F.col("__v")).alias("pairs"))


def with_fallback(
    hits: DataFrame,
    queries: DataFrame,
    key: str,
    kind: str,
    defaults: Mapping[str, str],
    text: str = "text",
    skipped=SKIPPED_TYPES,
) -> DataFrame:
    """Every query with its hit texts, or with the default guidance of its kind when it has none.

    Kinds in ``skipped`` are left out. ``defaults`` is a table written by hand: one text per kind.
    """
    wanted = queries.where(~F.coalesce(F.col(kind).isin(*skipped), F.lit(False))) if skipped else queries
    guidance = F.lit(NO_GUIDANCE)
    for name, value in defaults.items():
        guidance = F.when(F.col(kind) == name, value).otherwise(guidance)
    joined = wanted.select(key, kind).join(hits, key, "left")
    return joined.withColumn("is_fallback", F.when(F.col(text).isNull(), 1).otherwise(0)).withColumn(
        text, F.coalesce(F.col(text), guidance)
    )


def fallback_text(kind: Column, guidance: Column, reason: str = NOT_FOUND) -> Column:
    """Context text for a query without hits."""
    return F.concat(
        F.lit(f"{CONTEXT_HEAD}\n\nBlock type: "), kind,
        F.lit(f"\n{reason}\n\nFallback guidance:\n"), guidance,
        F.lit(f"\n\n{CONTEXT_TAIL}"),
    )


def context(
    hits: DataFrame,
    key: str,
    kind: str,
    rank: str = "rank",
    source: str = "source",
    pattern: str = "pattern_name",
    text: str = "text",
    name: str = "context",
) -> DataFrame:
    """One text per query from all its ranked hits, with a numbered heading for each.

    How many texts meet in one group is what the caller asked ``nearest`` for.
    """
    label = F.concat(
        F.lit("Pattern "), F.col(rank).cast("string"),
        F.lit(" (from "), F.coalesce(F.col(source), F.lit("unknown")), F.lit(")"),
        F.when(F.coalesce(F.col(pattern), F.lit("")) != "", F.concat(F.lit(": "), F.col(pattern))).otherwise(""),
    )
    piece = F.concat(label, F.lit("\n"), strip(F.col(text)), F.lit("\n"))
    return (
        hits.groupBy(key, kind)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), piece.alias("t")))).alias("__p"))
        .select(
            key,
            F.concat(
                F.lit(f"{CONTEXT_HEAD}\n\nBlock type: "), F.col(kind),
                F.lit("\nRelevant patterns retrieved: "), F.size("__p").cast("string"), F.lit("\n\n"),
                F.array_join(F.transform("__p", lambda p: p.getField("t")), "\n"),
                F.lit(f"\n{CONTEXT_TAIL}"),
            ).alias(name),
        )
    )
