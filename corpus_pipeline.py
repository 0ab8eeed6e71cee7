"""Corpus pipeline: language, common lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltine.llm import bpe, containment, langid, linededup, neardup
from cobaltine.llm.storage import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the language model rejects: null, without a letter, or below its calibrated confidence.

    The model learns from the rows whose doc_id is not held out.
    """
    learned = docs.filter(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(True)))
    model = langid.train(learned)
    return langid.accepted(docs.select(*COLUMNS), model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that at least ten documents share; n_chars follows the text."""
    return linededup.without_common_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, 0.8), and all rows without doc_id."""
    return neardup.without_near_duplicates(docs.select(*COLUMNS), size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold 80 % or more of a benchmark item's five-word shingles."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return containment.without_items(docs.select(*COLUMNS), benchmark, size=5, percent=80)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: hashed models and BPE have no SQL form; tests hold every stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written to Parquet below ``spark.checkpoint.dir`` and read again, so that none is computed twice."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
