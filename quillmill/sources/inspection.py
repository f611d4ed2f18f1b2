"""What a delivered file is by its bytes, and why it is not taken, before anything parses it."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of files that are taken, and bytes that mark active content of a page description.
TAKEN = (".pdf", ".docx", ".txt", ".md", ".csv", ".html", ".htm")
ACTIVE = (b"/javascript", b"/launch", b"/embeddedfiles")
PARTS = ("[Content_Types].xml", "word/document.xml")
HEAD = 8192


@dataclass(frozen=True)
class Limits:
    """The most bytes of a file, how many times that an archive may unpack to, and its ratio of unpacked to packed bytes."""

    size: int = 25 * 1024 * 1024
    expansion: int = 4
    ratio: float = 100.0


def family(data: bytes, suffix: str) -> str | None:
    """pdf, docx or text by the first bytes (an archive needs its name too); None for other binary files."""
    if data.startswith(b"%PDF-"):
        return "pdf"
    if suffix == ".docx" and zipfile.is_zipfile(io.BytesIO(data)):
        return "docx"
    return None if b"\0" in data[:HEAD] else "text"


def archive_problem(data: bytes, limits: Limits = Limits()) -> str | None:
    """The first reason against a word-processing archive; its directory is judged before any member is unpacked."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members = z.infolist()
            names = {m.filename for m in members}
            packed, unpacked = sum(max(m.compress_size, 1) for m in members), sum(m.file_size for m in members)
            reasons = (
                ("incomplete", not names.issuperset(PARTS)),
                ("macros", any(n.lower().endswith("vbaproject.bin") for n in names)),
                ("expands_too_far", unpacked > limits.expansion * limits.size),
                ("ratio", unpacked > limits.ratio * packed),
            )
            told = next((reason for reason, found in reasons if found), None)
            if told is None and any(b'TargetMode="External"' in z.read(n) for n in sorted(names) if n.lower().endswith(".rels")):
                told = "external_links"
            return told
    except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, zlib.error):
        return "broken_archive"


def content_problem(data: bytes, suffix: str, limits: Limits = Limits()) -> str | None:
    """The first reason against a file of this name and content, or None."""
    found = family(data, suffix)
    expected = {".pdf": "pdf", ".docx": "docx"}.get(suffix, "text")
    if found is None and expected == "text":
        return "binary"
    if found != expected:
        return "mismatch"
    if found == "pdf":
        lower = data.lower()
        return "active_content" if any(mark in lower for mark in ACTIVE) else None
    return archive_problem(data, limits) if found == "docx" else None


def suffix_of(path: Column) -> Column:
    """A file name's last extension with its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def inspected(spark: SparkSession, path: str, glob: str = "*", limits: Limits = Limits()) -> DataFrame:
    """``path``, ``length``, ``family`` and ``problem`` (null: taken) of the files below a path.

    Names and sizes are judged from the listing: files with another name and those over the
    limit are never read, so a task holds no file larger than the limit.  Spark's readers pass over files without a
    byte: these have no row.  A reason is one of ``unsupported``, ``too_large``, ``mismatch``, ``binary``, ``active_content``, ``incomplete``, ``macros``, ``expands_too_far``,
    ``ratio``, ``external_links`` and ``broken_archive``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("suffix", suffix_of(F.col("path")))
    by_name = F.when(~F.col("suffix").isin(*TAKEN), "unsupported").when(F.col("length") > limits.size, "too_large")
    refused = files.select("path", "length", F.lit(None).cast("string").alias("family"), by_name.alias("problem")).filter("problem is not null")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, family(data, s), content_problem(data, s, limits)) for p, n, s, data in zip(b["path"], b["length"], b["suffix"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "length", "family", "problem"])

    read = files.filter((F.col("length") <= limits.size) & F.col("suffix").isin(*TAKEN)).select("path", "length", "suffix", "content")
    return refused.unionByName(read.mapInPandas(look, "path string, length long, family string, problem string"))
