"""Queries that write and read back datasets. Files go to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import stepframe as sf

from .q_text import CHUNKS
from .registry import query

c = F.col


@query("save_roundtrip", "SELECT o_orderkey, o_totalprice * 2 AS double_price FROM orders")
def save_roundtrip(t):
    made = t.orders.select("o_orderkey", (c("o_totalprice") * 2).alias("double_price"))
    # a stored table under a two-level name, whose files are in the shared folder
    t.spark.sql(f"CREATE DATABASE IF NOT EXISTS stepframe_saved LOCATION '{sf.scratch_path(t.spark, 'database')}'")
    name = f"stepframe_saved.orders_{uuid.uuid4().hex}"
    sf.save(made, name, table=True)
    return sf.read(t.spark, name)


@query(
    "csv_roundtrip",
    """SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority, c_name FROM orders
       JOIN customer ON o_custkey = c_custkey""",
)
def csv_roundtrip(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", c("o_orderdate").cast("date"), "o_orderpriority")
    customers = t.customer.select("c_custkey", F.concat(c("c_name")).alias("c_name"))
    base = sf.scratch_path(t.spark, "csv")
    paths = sf.export({"orders": orders, "customers": customers}, base)
    a = sf.import_csv(t.spark, paths[0], orders.schema)
    b = sf.import_csv(t.spark, paths[1], customers.schema)
    return a.join(b, c("o_custkey") == c("c_custkey")).drop("o_custkey", "c_custkey")


@query(
    "list_input",
    """SELECT o_orderkey AS id, o_orderstatus AS name, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS cust,
              o_orderdate::DATE AS dob, o_totalprice AS price FROM orders""",
)
def list_input(t):
    line = F.concat_ws(
        "  ", c("o_orderkey"), c("o_orderstatus"), F.when(c("o_orderkey") % 5 == 0, ".").otherwise(c("o_custkey").cast("string")),
        sf.put(c("o_orderdate"), "date9."), c("o_totalprice"),
    )
    fields = sf.parse_fields(line, "id bigint, name string, cust bigint, dob date, price double")
    return t.orders.select(fields.alias("r")).select("r.*")


@query(
    "text_scan",
    """SELECT lang, source, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY lang, source""",
)
def text_scan(t):
    base = sf.scratch_path(t.spark, "texts")
    t.documents.select("lang", "source", "text").write.partitionBy("lang", "source").text(base)
    found = sf.read_text_lines(t.spark, base)
    part = lambda name: F.regexp_extract("filepath", f"{name}=([^/]+)", 1).alias(name)
    return (
        found.select(part("lang"), part("source"), (F.length("line") + 1).alias("n"))
        .groupBy("lang", "source")
        .agg(F.sum("n").alias("chars"))
    )


@query(
    "chunk_append",
    f"""SELECT source, '/' || source || '/' || doc_id || '.txt' AS filepath, chunk_index, text FROM {CHUNKS}""",
)
def chunk_append(t):
    docs = t.documents.select(
        "source", "lang", F.concat(F.lit("/"), c("source"), F.lit("/"), c("doc_id"), F.lit(".txt")).alias("filepath"), "text"
    )
    chunks = sf.size_chunks(docs).withColumn("section_index", F.lit(0))
    base = sf.scratch_path(t.spark, "chunks")
    sf.save_chunks(chunks.where("lang <> 'en'"), base, rebuild=True)
    return sf.save_chunks(chunks, base).select("source", "filepath", "chunk_index", "text")


@query("split_by_value", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def split_by_value(t):
    base = sf.scratch_path(t.spark, "split")
    sf.write_by_value(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderpriority", base)
    return t.spark.read.parquet(base)
