"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns the next stage's documents; the last returns
pieces of packed sequences. ``run`` writes every stage's result and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wearline.llm import lines, mixing, near, packing, quality
from wearline.llm.shared import read_documents
from wearline.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before; one left without a word goes."""
    return lines.dedup_lines(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, by five-word shingles."""
    return near.keep_first(docs)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4,096 tokens, at the shares of the mix while all sources last."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), weights=(5, 2, 1))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_near_copies),
    ("mixing", mixed_to_targets),
    ("packing", packed),
]

# Edit similarity, MinHash and the tokenizer are beyond SQL; a test compares every stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
