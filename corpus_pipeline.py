"""A corpus pipeline over ``documents``; it belongs to the subpackage ``cladeweave.llm``.

Each stage takes all that its predecessor kept and returns the columns of ``documents``; the last one
adds the token ids and the text that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cladeweave.llm import decontaminate, exact_dedup, jaccard_join, sentencepiece_codec, toxicity
from cladeweave.llm.shared import new_folder, read_table, shuffles_removed


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, Jaccard 0.8) the smallest id stays."""
    return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the end id, of every document that is left, in ``token_ids``; their text in ``decoded``."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_and_decode(docs, model)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SQL cannot express the learned, metric and alignment stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        made = stage(spark, docs, sf_dir)
        with shuffles_removed(spark):
            made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
