"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, byte-pair encoding.

Every stage takes the documents that its predecessor kept, applies its operator's decisions to all of them, and returns
the columns of documents; the last returns the tokens. ``run`` chains the stages over written Parquet.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns, whose
names may be those that the operators use. A null text has no language and goes in the first stage, as do texts without a
letter. Rows with a null id keep their lines and are never dropped as near-copies. Of documents at one place in an order
(copies, repeated rows) all are treated alike, so repeated rows stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe_codec, decontaminate, language_id, line_dedup, simhash
from pulsegrid.llm.common import held_out, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language; lang becomes the predicted one. Learns from those that are not held out."""
    model = language_id.train(docs.where(~held_out()))
    columns = docs.columns
    found = language_id.predicted(docs, model, tuple(columns)).where(F.col("lang_pred") != "und")
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each component, the first by id; a document that loses every line stays, with an empty text."""
    return line_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component; documents without an id stay."""
    found = simhash.classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    once = docs.join(found, F.col("doc_id") == F.col("_gone"), "left_anti")
    return once.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are contaminated by the benchmark."""
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), tuple(docs.columns)).where("NOT contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text of each document, as digests."""
    return bpe_codec.digests(docs, bpe_codec.default_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe_encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written to the shared folder and read again. No documents give no rows."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
