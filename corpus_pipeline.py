"""From raw documents to token ids: civil, deduplicated by line and by document, mixed, encoded.

Every stage takes whole texts of any length and gives an empty table for an
empty one.  A null or empty text passes the first three stages, unless it is a
near copy of another such text, has no words to mix, and so ends there.  A null
doc_id is a document that no line count knows and that no copy is kept for.
Repeated rows are treated alike by the first two stages, stay or go together in
the third, and are documents of their own in the fourth.  Columns other than
those of documents are dropped, so none can clash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm import bpe, linededup, mixing, simhash, toxicity
from mergeloom.runtime import forget, trim_driver, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    trim_driver(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_civil(docs.select(*COLUMNS), labels)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in many documents stay only in the last of them."""
    trim_driver(spark)
    cleaned = linededup.dedup_lines(docs.select(*COLUMNS))
    return cleaned.withColumns({"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    trim_driver(spark)
    return simhash.near_dedup(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their training positions."""
    trim_driver(spark)
    return mixing.curriculum(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of them and of what they decode to."""
    trim_driver(spark)
    encoded = bpe.encode_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return encoded.select(
        "doc_id", "lang", "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "token_ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix),
    ("bpe", encode),
]

#: A trained model decides in the first stage and hashes and vocabularies in later ones: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
