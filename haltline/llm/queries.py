"""Registered queries of the operators of this subpackage, each over its whole table."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltline.llm import sql
from haltline.llm.cgk_leaks import leaked_items
from haltline.llm.chat_format import chat_digests, read_chats, write_chats
from haltline.llm.cover_tree import top_inner_products
from haltline.llm.gear_chunks import drop_repeated
from haltline.llm.knn_quality import quality_model, quality_scores
from haltline.llm.line_blocks import extract_main_text
from haltline.llm.merkle_manifest import verified_rows
from haltline.llm.order_minhash import near_duplicates
from haltline.llm.packed_ids import packed_digests, read_packed_ids, write_packed_ids
from haltline.llm.periodic_runs import periodic_runs
from haltline.llm.piece_tokens import piece_digests
from haltline.llm.rank_counts import token_counts
from haltline.llm.sa_dedup import removal_digests
from haltline.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(_table(spark, sf_dir, "documents"))


def op2_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return piece_digests(docs, public_tokenizers.path(PIECE_MODEL))


def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/packed/{uuid.uuid4()}"
    docs = _table(spark, sf_dir, "documents")
    write_packed_ids(docs, public_tokenizers.path(BYTE_MODEL), path)
    return packed_digests(read_packed_ids(spark, path))


def op4_rank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path(PIECE_MODEL))


def op5_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_scores(docs, quality_model(docs, _table(spark, sf_dir, "labels")))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated(_table(spark, sf_dir, "documents"))


def op8_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"))


def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op10_cgk_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/chats/{uuid.uuid4()}"
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
        "conv_id long, turn long, role string, text string",
    )
    turns = _table(spark, sf_dir, "conversations").select(more.columns).unionByName(more)
    write_chats(turns, path)
    return chat_digests(read_chats(spark, path))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/manifest/{uuid.uuid4()}"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    altered = F.when(tampered, lowered).otherwise(F.col("text"))
    return verified_rows(_table(spark, sf_dir, "documents"), path, altered)


def _with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document goes on from some word on in a loop."""
    key = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(key % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", F.floor(key / 10).alias("seed"), words.alias("words"))
    n = F.nullif(F.size("words"), F.lit(0))
    placed = split.withColumn("first", (F.col("seed") % n).cast("int")).withColumn(
        "period", (1 + F.floor((n - F.col("first")) / (3 + F.col("seed") % 8))).cast("int")
    )
    rest = n - F.col("first")
    root = F.slice("words", F.col("first") + 1, F.col("period"))
    looped = F.flatten(F.array_repeat(root, F.ceil(rest / F.col("period")).cast("int")))
    changed = F.concat(F.slice("words", F.lit(1), F.col("first")), F.slice(looped, F.lit(1), rest))
    return placed.select(
        "doc_id", F.when(n > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text")
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_loops(_table(spark, sf_dir, "documents")))
    # The first of those with the greatest exponent, in the order of start and period.
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    higher = lambda best, one: (
        best.isNull() | (one["length"] * best["period"] > best["length"] * one["period"])
    )
    best = F.aggregate("runs", none, lambda best, one: F.when(higher(best, one), one).otherwise(best))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_piece_tokens": op2_piece_tokens,
    "op3_packed_ids": op3_packed_ids,
    "op4_rank_counts": op4_rank_counts,
    "op5_knn_quality": op5_knn_quality,
    "op6_order_minhash": op6_order_minhash,
    "op7_gear_chunks": op7_gear_chunks,
    "op8_cover_tree_search": op8_cover_tree_search,
    "op9_line_blocks": op9_line_blocks,
    "op10_cgk_leaks": op10_cgk_leaks,
    "op11_chat_template": op11_chat_template,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op8_cover_tree_search": sql.TOP_PRODUCTS,
    "op11_chat_template": sql.CHAT_DIGESTS,
    "op12_merkle_manifest": sql.MERKLE_ROWS,
    "op13_periodic_runs": sql.PERIODIC_RUNS,
}
