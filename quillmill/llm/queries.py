"""The thin queries over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.common import documents, prepare
from quillmill.llm.oracle import ORACLE_SQL


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmill.llm.byte_bpe import encode_digests

    return encode_digests(documents(prepare(spark), sf_dir), _tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.quality_rules import judged

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(documents(prepare(spark), sf_dir)).select(*names)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.substring_dedup import repeated_spans

    return repeated_spans(documents(prepare(spark), sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.packing import pack

    return pack(documents(prepare(spark), sf_dir), _tokenizer_file("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.toxicity import fit, scored

    docs = documents(prepare(spark), sf_dir)
    return scored(docs, fit(docs, documents(spark, sf_dir, "labels")))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.suffix_tree_lm import scored

    return scored(documents(prepare(spark), sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.secret_scan import arrivals, incremental_secrets

    return incremental_secrets(arrivals(documents(prepare(spark), sf_dir)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.simhash import near_duplicates

    return near_duplicates(documents(prepare(spark), sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.jpeg_media import media_column, media_features

    return media_features(media_column(documents(prepare(spark), sf_dir)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.license_scan import licences

    return licences(documents(prepare(spark), sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.lexical_search import ranked

    return ranked(documents(prepare(spark), sf_dir), documents(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.language_id import fit, identified

    docs = documents(prepare(spark), sf_dir)
    return identified(docs, fit(docs))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.conversation_repair import audited, damaged

    return audited(damaged(documents(prepare(spark), sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_tree_lm": op6_suffix_tree_lm,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash": op8_simhash,
    "op9_media_columns": op9_media_columns,
    "op10_license_scan": op10_license_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_language_id": op12_language_id,
    "op13_conversation_repair": op13_conversation_repair,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
