"""Documents cut into sections, parts and children, as rows with parents.

A text's form feeds part its pages.  Nothing is shuffled: each task cuts its own documents,
and rows leave it as they are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.sectioning import PROFILES, sectioned
from quillmill.plans.catalogue import register
from quillmill.sources.views import table

_NAMES = ("doc_id", "section_id", "parent_section_id", "chunk_type", "title", "start_page", "end_page", "content")
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
_SCHEMA = "doc_id long, section_id string, parent_section_id string, chunk_type string, title string, start_page int, end_page int, content string"


def section_rows(docs: DataFrame, profile: str = "next") -> DataFrame:
    """Rows of all documents (``doc_id``, ``text``) by a profile; a null or blank text has none."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], list(_NAMES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in sectioned((text or "").split("\f"), profile):
                    rows.append((i, *s))
                    if len(rows) >= 1000:
                        yield flush(rows)
                        rows = []
        if rows:
            yield flush(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _SCHEMA)


@register("document_sections")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section, part and child of every document, with the digest that upserts go by."""
    rows = section_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "section_id", "parent_section_id", "chunk_type", "title", "start_page", "end_page", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_hash"))


@register("section_profiles")
def section_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both profiles side by side: how many rows of each kind, how long on average and at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = [section_rows(docs, p).select(F.lit(p).alias("profile"), "chunk_type", F.length("content").alias("n")) for p in PROFILES]
    return both[0].unionByName(both[1]).groupBy("profile", "chunk_type").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 3).alias("mean_chars"), F.max("n").alias("most_chars"))
