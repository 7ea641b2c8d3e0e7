"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockline.llm import bpe, chat, hnsw, langid, lexical, lines, minhash, mixing, packing, phrases, reputation, suffixes, topk


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, path: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, path, "documents"))


def op2_source_mixing(spark: SparkSession, path: str) -> DataFrame:
    return mixing.mix(read(spark, path, "documents")).drop("source", "copies")


def op3_embedding_dedup(spark: SparkSession, path: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, path, "embeddings"))


def op4_language_id(spark: SparkSession, path: str) -> DataFrame:
    return langid.identify(read(spark, path, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, path: str) -> DataFrame:
    return suffixes.dedup_substrings(read(spark, path, "documents"))


def op6_chat_rotation(spark: SparkSession, path: str) -> DataFrame:
    return chat.rotate(read(spark, path, "conversations"))


def op7_curve_packing(spark: SparkSession, path: str) -> DataFrame:
    return packing.pack(read(spark, path, "documents"))


def op8_url_reputation(spark: SparkSession, path: str) -> DataFrame:
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    outcomes = read(spark, path, "labels").select(F.col("doc_id").alias("page_id"), good).filter("good IS NOT NULL")
    return reputation.judge(read(spark, path, "pages"), outcomes)


def op9_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    return lines.dedup_lines(read(spark, path, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_exact_topk(spark: SparkSession, path: str) -> DataFrame:
    return topk.top_k(read(spark, path, "embeddings"))


def op11_lexical_search(spark: SparkSession, path: str) -> DataFrame:
    return lexical.search(read(spark, path, "documents"), read(spark, path, "benchmark"))


def op12_byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(read(spark, path, "documents")))
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return rows.select("doc_id", "n_tokens", *digests)


def op13_collocations(spark: SparkSession, path: str) -> DataFrame:
    return phrases.collocations(read(spark, path, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_chat_rotation": op6_chat_rotation,
    "op7_curve_packing": op7_curve_packing,
    "op8_url_reputation": op8_url_reputation,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_topk": op10_exact_topk,
    "op11_lexical_search": op11_lexical_search,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op6_chat_rotation": chat.rotate_sql(),
    "op2_source_mixing": f"WITH {mixing.mix_sql('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed",
    "op8_url_reputation": reputation.judge_sql(),
    "op9_line_dedup": f"WITH {lines.lines_sql('documents')} SELECT doc_id, n_lines, n_removed, text FROM cleaned",
    "op11_lexical_search": lexical.search_sql("documents", "benchmark"),
    "op13_collocations": phrases.collocations_sql("documents"),
}
