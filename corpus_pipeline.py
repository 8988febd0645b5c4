"""From raw documents to token ids: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltline.llm.cgk_leaks import without_leaks
from haltline.llm.knn_quality import keep_quality, quality_model
from haltline.llm.order_minhash import one_of_each
from haltline.llm.piece_tokens import encode_pieces
from haltline.llm.sa_dedup import without_repeats
from haltline.session import keep_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

PIECE_MODEL = "piece_bpe_32k.model"
#: A passage of 50 words has 200 bytes or more, that of operator 1's own query 400.
PASSAGE_BYTES = 200
#: Bytes of the strings that name windows of so many bytes.
PASSAGE_GRAM = 64


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, quality_model(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, with all columns."""
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents and columns, strings of `PASSAGE_BYTES` that start elsewhere too cut out of the texts."""
    return without_repeats(docs, PASSAGE_BYTES, gram=PASSAGE_GRAM).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all columns."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded, n_tokens) of every document."""
    encoded = encode_pieces(docs, public_tokenizers.path(PIECE_MODEL))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", tokenize),
]

#: SQL cannot express the classifier, edit similarity and the tokenizer; tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep_table(stage(spark, docs, sf_dir))
    return docs
