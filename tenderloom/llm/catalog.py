"""Queries op1 to op13 over the provided tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, boosting, isolation, jaccard, laesa, linededup, mixing, planes, secrets, sentencepieces, simhash, urlrules, wrappers
from .common import shared_folder, table, word_count, written


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = isolation.measured(table(spark, sf_dir, "documents"))
    return isolation.judge_counts(counted, isolation.fit_counts(counted, table(spark, sf_dir, "labels")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = shared_folder(spark, "token-files")
    planes.write_ids(table(spark, sf_dir, "documents"), path, lambda: planes.encoder_for(vocabulary, end_id=2))
    return planes.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mixing.mix(sized, F.col("size")).select("row.doc_id", "size", "source_size", "target", "taken")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, verdict string")
    return urlrules.filter_urls(table(spark, sf_dir, "pages"), rules)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return boosting.score_quality(docs, boosting.fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "part_mismatches", "round_trip")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_prints: for doc_id divisible by 100, the other fingerprints of the table within the radius."""
    found = written(simhash.edited(table(spark, sf_dir, "documents")), "fingerprints")
    prints = found.select("doc_id", F.col("own_high").alias("high"), F.col("own_low").alias("low"))
    asked = F.col("doc_id") % 100 == 0
    near = simhash.find_near(prints, prints.where(asked)).groupBy(F.col("high").alias("own_high"), F.col("low").alias("own_low")).agg(F.count("*").alias("n"))
    pair = lambda p: (F.col(f"{p}_high"), F.col(f"{p}_low"))
    return found.join(near, ["own_high", "own_low"], "left").select(
        "doc_id", "n_chars", "edited_sha256", simhash.shown(*pair("own")).alias("fingerprint"), simhash.shown(*pair("edited")).alias("edited_fingerprint"),
        simhash.likeness(pair("own"), pair("edited")).alias("near_edited"), simhash.likeness(pair("own"), pair("next")).alias("near_next"),
        F.when(asked, F.coalesce("n", F.lit(0))).alias("near_prints"),
    )


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = F.col("spans")
    base = secrets.of_kind(spans, "assign", "access", "hex")
    return secrets.find_secrets(docs, secrets.identifier_dictionary(docs)).select(
        "doc_id", *(F.size(secrets.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.spelled(base).cast("binary"), 256).alias("base_sha256"), secrets.spelled(spans).alias("spans"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = laesa.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(None if books is None else books.digest()).cast("string")
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_files": op3_token_files,
    "op4_source_mixing": op4_source_mixing,
    "op5_url_filters": op5_url_filters,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_fingerprints": op10_fingerprints,
    "op11_secret_scans": op11_secret_scans,
    "op12_vector_codes": op12_vector_codes,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLE: dict[str, str] = {
    "op4_source_mixing": mixing.ORACLE,
    "op5_url_filters": urlrules.ORACLE,
    "op6_line_dedup": linededup.ORACLE,
    "op12_vector_codes": laesa.oracle(),
}
