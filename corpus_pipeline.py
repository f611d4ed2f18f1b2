"""A training corpus from ``documents``: each stage takes what its predecessor kept.

Toxic documents go; of each group of near duplicates one document stays; later copies
of repeated passages are cut out; secrets are masked; what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.common import discard, documents, prepare, stored
from quillmill.llm.packing import pack
from quillmill.llm.secret_scan import masked
from quillmill.llm.simhash import keep_first
from quillmill.llm.substring_dedup import without_repeats
from quillmill.llm.toxicity import clean, fit


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = documents(prepare(spark), sf_dir, "labels")
    return clean(docs, fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The stages hash, learn and tokenise, which SQL can't express; the tests compare the near-duplicate stage with brute force, and others by their effects.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
            if k:
                discard(given)
    return docs
