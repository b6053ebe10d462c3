"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._text import small_batches
from .preferences import ORACLE as PREFERENCES_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a Katz backoff model of six sevenths of them."""
    from .katz import katz_scores, train_share

    return katz_scores(_table(spark, sf_dir, "documents"), train_share())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item with edits to a tenth of it at most, and where."""
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, by templates of their hosts."""
    from .html_template import main_texts

    return main_texts(_table(spark, sf_dir, "pages"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal counts, in Hilbert order of language, source and length."""
    from .hilbert_shards import shard_rows

    return shard_rows(_table(spark, sf_dir, "documents"), 24)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base matches and what the boosted trees add."""
    from .pii import pii_spans, train

    docs = _table(spark, sf_dir, "documents")
    return pii_spans(docs, train(docs))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of all documents."""
    import public_tokenizers

    from .byte_bpe import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages, by rules and else by the ratio of two character models."""
    from .url_model import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, completions and masks for the pair that each conversation gives."""
    from .preferences import conversations_as_arrays, format_preferences, last_reply_pairs

    pairs = last_reply_pairs(conversations_as_arrays(_table(spark, sf_dir, "conversations")))
    return format_preferences(pairs).withColumnRenamed("pair_id", "conv_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), shingle_words=4, percent=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents, by compression bands fitted on documents that are labelled good."""
    from .quality_rules import fit_bands, quality_features

    docs = _table(spark, sf_dir, "documents")
    return quality_features(docs, rules=fit_bands(docs, _table(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repairs of all conversations, of which some rows are damaged."""
    from .conversation_repair import repair_digests

    return repair_digests(_table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ids of two tokenizers meet in all documents, by counts over the whole corpus."""
    import public_tokenizers

    from .token_alignment import alignment_scores

    return alignment_scores(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, counts and checksums of the ids of all documents, from token files in ascending order of doc_id."""
    import public_tokenizers

    from .token_files import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


QUERIES = {
    "op1_katz": op1_katz,
    "op2_decontamination": op2_decontamination,
    "op3_html_template": op3_html_template,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_pii": op5_pii,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_url_model": op7_url_model,
    "op8_preferences": op8_preferences,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {"op8_preferences": PREFERENCES_SQL}
