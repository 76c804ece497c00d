"""From raw documents to packed training sequences: quality rules, toxicity, near-duplicates, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Defined results: documents with null or empty texts fail the quality rules and go; very long texts are judged whole; repeated rows are near-duplicates, of which the one of least id stays; an empty table, or one of which nothing is kept,
gives no pieces; further columns are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.best_fit_packing import pack, token_pieces
from lodestone.llm.common import fold, materialize, unfold
from lodestone.llm.minhash_dedup import without_duplicates
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.registry import held_out
from lodestone.llm.toxicity import toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return unfold(quality_rules(fold(docs, "text", "lang")).filter("kept"), docs.columns, "text", "lang")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the weights come from the labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out(4))
    labelled = docs.select("doc_id", "text").join(labels, "doc_id").select("text", "toxic")
    return unfold(toxicity(fold(docs, "text"), labelled).filter("score < 0.3"), docs.columns, "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return without_duplicates(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens."""
    pieces = token_pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)
    return pack(pieces, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express none of the perplexity model, the restoration of words and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k + 1}")
    return docs
