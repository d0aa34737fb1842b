"""From raw documents to packed training sequences, in stages that each call one operator.

Each stage takes what its predecessor kept, as a table that was written and read again. All but the last return the
columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepframe.llm import decontaminate, packing, pii, quality_lm, simhash
from stepframe.llm.common import written
from stepframe.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not beyond their language's bound."""
    return quality_lm.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are similar by 0.8 or more."""
    return simhash.keep_one_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items are less than one word in twenty, without the items' words; ``n_chars`` follows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), chars="n_chars" if "n_chars" in docs.columns else None)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it generalised; ``n_chars`` follows the text."""
    return pii.sanitise(docs, chars="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", pack),
]

#: the model, the tokenizer and connected components have no SQL; tests compare with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
