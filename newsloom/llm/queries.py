"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontamination, jaccard, languages, licences, manifest, neighbours, pages, quality, sentencepieces, substrings, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.digests(sentencepieces.encode_decode(docs, piece_model_path()))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    kept = substrings.deduplicate(docs, substrings.RUN_WORDS)
    return kept.select("doc_id", F.col("has_run").alias("has_repeats"), "n_removed", "removed", "n_chars", "text")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts.report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents"))


def licence_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base phrases give, which SQL can express."""
    return licences.base_report(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), piece_model_path())


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_neighbours": op4_neighbours,
        "op5_token_counts": op5_token_counts,
        "op6_html_extraction": op6_html_extraction,
        "op7_licence_scan": op7_licence_scan,
        "op8_language_id": op8_language_id,
        "op9_quality": op9_quality,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_alignment": op11_alignment,
        "op12_chat_formatting": op12_chat_formatting,
        "op13_merkle_manifest": op13_merkle_manifest,
        "licence_base_places": licence_base_places,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.REPORT_SQL,
        "op10_ngram_jaccard": jaccard.SQL,
        "op12_chat_formatting": chat.SQL,
        "op13_merkle_manifest": manifest.SQL,
        "licence_base_places": licences.BASE_SQL,
    }
