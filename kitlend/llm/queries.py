"""One registered query for each operator, over its whole table, and the DuckDB
SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitlend.llm import (bitplanes, bpe, chat, codes, html_text, linebits, mixing, neardup, quality, sql, token_counts,
                         topk, toxicity, warc)


def vocabulary() -> str:
    """The vocabulary file of operators 2 and 3, from the installed package."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary())


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(_table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded_vectors(_table(spark, sf_dir, "embeddings"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.clustered_vectors(_table(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linebits.cleaned_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_token_counts, op3_bpe_round_trip, op4_mix_sources,
                            op5_near_duplicates, op6_toxicity, op7_html_text, op8_exact_top_k, op9_quality_rules,
                            op10_warc_revisits, op11_vector_codes, op12_centroid_clusters, op13_line_dedup)}

ORACLE: dict[str, str] = {"op4_mix_sources": sql.MIX, "op8_exact_top_k": sql.TOP_K, "op10_warc_revisits": sql.WARC,
                          "op11_vector_codes": sql.CODES, "op12_centroid_clusters": sql.CLUSTERS,
                          "op13_line_dedup": sql.LINES}
