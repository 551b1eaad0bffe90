"""The queries op1 to op13, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, fingerprints, html_text, lexical_search, license_scan, line_dedup, near_dedup, packing, pii, quality, sentencepiece_codec, toxicity


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), size=2048, end_id=1)


def op3_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), pii.session_key(spark)).select("doc_id", "text", "n_found", "n_changed")


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


def op7_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op8_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), digests=True)


def op11_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_set_similarity_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents")).drop("matches")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fuzzy_lines, op2_sum_of_squares_packing, op3_nonnegative_pu, op4_content_sort, op5_feistel_pseudonyms, op6_weighted_sampling, op7_block_labeller, op8_attention_mil, op9_circulant_minhash, op10_sentencepiece, op11_interval_alignment, op12_block_max_search, op13_set_similarity_licenses)
}

ORACLE: dict[str, str] = {"op4_content_sort": exact_dedup.ORACLE, "op9_circulant_minhash": near_dedup.ORACLE, "op12_block_max_search": lexical_search.ORACLE, "op13_set_similarity_licenses": license_scan.ORACLE}
