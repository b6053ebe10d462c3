"""A corpus-cleaning pipeline; each stage takes (spark, docs, sf_dir) and its result is the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from signalmill.llm._text import ensure_checkpoint_dir, remove_folder, small_batches
from signalmill.llm.byte_bpe import with_tokens
from signalmill.llm.decontaminate import drop_leaks
from signalmill.llm.jaccard_join import keep_first
from signalmill.llm.pii import redact, train
from signalmill.llm.quality_rules import fit_bands, keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by limits fitted on documents that are labelled good."""
    small_batches(spark)
    return keep_good(docs, rules=fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    return keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    small_batches(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by the name of its kind."""
    small_batches(spark)
    return redact(docs, train(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, which decode to their texts."""
    small_batches(spark)
    encoded = with_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.selectExpr("doc_id", "lang", "source", "n_chars", "CAST(size(token_ids) AS BIGINT) AS n_tokens", "token_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii),
    ("byte-level BPE", byte_bpe),
]

#: The compression, search and tokenizer stages are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of a folder, each written and read again."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return docs
