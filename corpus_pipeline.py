"""Corpus cleaning pipeline over ``documents``, from quality rules to tokens.

Each stage is one operator of ``marketpulse.llm``.  A stage works on all that
the one before kept, its result is written as Parquet in the shared folder and
read again, so a lost executor costs at most the running stage.  All stages but
the last return the columns of ``documents``.

Nulls, empty texts, ties, repeated rows and empty tables are handled as the
operators state: a null or empty text fails the quality rules; of equal keys
in a duplicate group the first row stays; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketpulse.llm import bpe, decontaminate, line_dedup, repetition, simhash
from marketpulse.llm.common import saved
from marketpulse.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and repetition rules keep."""
    return repetition.keep(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source leave the texts; ``n_chars`` follows
    the text.  Copies of a text count as one page, so that none is boilerplate
    by its copies."""
    out = line_dedup.cleaned(docs)
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_dropped") > 0, F.length("doc.text")).otherwise(F.col("doc.n_chars"))
        out = out.withColumn("doc", F.col("doc").withField("n_chars", size.cast(docs.schema["n_chars"].dataType)))
    return out.select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the least doc_id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy a benchmark item go."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document left."""
    return bpe.digests(docs, tokenizer_path(), ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: SQL has neither XXH64 fingerprints nor this tokenizer; tests/llm compares
#: the pipeline with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
