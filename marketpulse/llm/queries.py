"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketpulse.llm import (
    bpe, decontaminate, embedding_dedup, langid, lexical, line_dedup, quality_net, repetition, secrets, simhash, suffix_dedup,
    token_alignment, url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def piece_path() -> str:
    """The public piece vocabulary that language identification uses."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"), piece_path())


def op4_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on every document."""
    out = repetition.quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_covered_words")


def tokenizer_path() -> str:
    """The public tokenizer file that the queries encode with."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality_net.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, from a ledger that starts empty."""
    rows, _ = secrets.findings(_table(spark, sf_dir, "documents"))
    return secrets.summary(rows)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines dropped from every document, ``source`` being its site."""
    out = line_dedup.cleaned(_table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("doc.text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it copies."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated byte strings removed from every document."""
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def alignment_paths() -> tuple[str, str]:
    """The public byte-level and piece vocabularies that are aligned."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned on every document, with corpus-wide link counts."""
    return token_alignment.align(_table(spark, sf_dir, "documents"), *alignment_paths())


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


REGISTRY = {f.__name__: f for f in (
    op1_simhash_dedup, op2_url_filter, op3_language_id, op4_repetition_quality, op5_bpe_encoding, op6_quality_classifier, op7_secret_scan,
    op8_line_dedup, op9_decontamination, op10_suffix_dedup, op11_token_alignment, op12_lexical_search, op13_embedding_dedup,
)}
