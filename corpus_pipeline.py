"""Documents from raw text to training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from meridex.llm import decontam, lines, ngrams, packing, quality
from meridex.llm.shared import shared_folder


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_classifier", quality.keep_good),
    ("line_dedup", lines.drop_lines),
    ("ngram_jaccard_join", ngrams.one_of_each),
    ("benchmark_decontamination", decontam.drop_contaminated),
    ("packing", pack_documents),
]

#: Learnt scores and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written in the shared folder and read again."""
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
    return docs
