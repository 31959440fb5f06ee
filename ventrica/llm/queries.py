"""The numbered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .audit import audit_conversations
from .decontaminate import leaked_items
from .embed_dedup import near_duplicate_vectors
from .html_text import extract_main_text
from .language import document_languages, document_models, page_languages
from .licenses import scan_licenses
from .line_dedup import drop_repeated_lines
from .near_dup import near_duplicates
from .packing import pack
from .quality import quality_sample
from .vector_codes import compress_vectors
from .warc import read_archive, write_archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op3_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(write_archive(_table(spark, sf_dir, "pages"))).drop("url", "html")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of raw pages (doc_id null) and of documents (page_id null); the text models are learned from the documents' labels."""
    docs = _table(spark, sf_dir, "documents")
    table = document_models(docs)
    return document_languages(docs, table).unionByName(page_languages(_table(spark, sf_dir, "pages"), table), allowMissingColumns=True)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chat(_table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(_table(spark, sf_dir, "conversations"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(_table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_warc_roundtrip": op3_warc_roundtrip,
    "op4_license_scan": op4_license_scan,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_resampling": op6_quality_resampling,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_decontamination": op10_decontamination,
    "op11_structure_repair": op11_structure_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op9_chat_format": chat.ORACLE,
}
