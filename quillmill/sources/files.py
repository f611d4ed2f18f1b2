"""Readers of sections, tables and documents in files."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "source_file string, country string, language string, section_id string, title string, content string"
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
#: What a broken archive, workbook or table raises.
BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, csv.Error, KeyError, IndexError, ValueError, EOFError, NotImplementedError, RuntimeError)


def read_sections(spark: SparkSession, path: str, schema: str = SECTION) -> DataFrame:
    """JSON lines; blank lines are skipped and broken ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each record's fields joined by " | "."""
    rows = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.concat_ws(" | ", *rows.columns).alias("content"))


def _decoded(data: bytes) -> str:
    for e in ENCODINGS:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processing file."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def xlsx_rows(data: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet, as text."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/"))))
    out = []
    for row in sheet.iter(f"{m}row"):
        cells = []
        for c in row.iter(f"{m}c"):
            value = c.find(f"{m}v")
            if c.get("t") == "s" and value is not None:
                cells.append(shared[int(value.text)])
            elif c.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{m}t")))
            else:
                cells.append("" if value is None else value.text or "")
        out.append(cells)
    return out


def resolved_header(header: list[str], aliases: dict[str, tuple[str, ...]]) -> dict[str, int]:
    """Place of each wanted column, by any of its names without case, spaces and marks."""
    plain = lambda x: re.sub(r"[^a-z0-9]", "", x.lower())
    found = {plain(h): i for i, h in reversed(list(enumerate(header)))}
    return {name: next((found[plain(a)] for a in (name, *other) if plain(a) in found), -1) for name, other in aliases.items()}


def csv_rows(data: bytes) -> list[list[str]]:
    """Records of a table of text, by the first of ``ENCODINGS`` that reads it; blank lines are left out."""
    return [r for r in csv.reader(io.StringIO(_decoded(data), newline="")) if r]


def read_plans(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], header_row: int = 0) -> DataFrame:
    """Rows of test plans (workbooks and CSV files), with the columns that ``aliases`` names; absent ones are empty.

    A file that can't be read has one row of nulls with its ``error``; the others' is null.
    """
    names = list(aliases)

    def read(batches):
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    cells = xlsx_rows(data) if p.lower().endswith(".xlsx") else csv_rows(data)
                except BROKEN as e:
                    rows.append((p, *[None] * len(names), f"{type(e).__name__}: {e}"))
                    continue
                at = resolved_header(cells[header_row], aliases) if len(cells) > header_row else {}
                rows += [(p, *[r[at[n]] if 0 <= at[n] < len(r) else "" for n in names], None) for r in cells[header_row + 1 :]]
            yield pd.DataFrame(rows, columns=["path", *names, "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,csv}").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, " + ", ".join(f"`{n}` string" for n in names) + ", error string")


def recognised_pages(blocks: DataFrame) -> DataFrame:
    """Lines that a recogniser found (document, page, line, kind, text) as one text a page."""
    lines = F.array_sort(F.collect_list(F.struct("line", "text")))
    return blocks.filter("kind = 'LINE'").groupBy("document", "page").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def kind_of(path: str, data: bytes) -> str:
    """What the bytes say, before what the name says."""
    if data.startswith(b"%PDF"):
        return "pdf"
    if data.startswith(b"PK\x03\x04"):
        return "docx" if path.lower().endswith(".docx") else "zip"
    if b"\0" in data[:4096]:
        return "binary"
    return path.rsplit(".", 1)[-1].lower() if "." in path else "txt"


def text_of(kind: str, data: bytes) -> str | None:
    """The text of a file of this kind; None where the kind has no reader."""
    if kind == "docx":
        return docx_text(data)
    if kind in ("html", "htm"):
        return html.unescape(re.sub(r"<[^>]*>", " ", _decoded(data)))
    if kind == "csv":
        return "\n".join(" | ".join(r) for r in csv_rows(data))
    return _decoded(data) if kind in ("txt", "md", "json") else None


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, kind, text and error of files; what has no text reader gets a null text, and a broken file its error instead of an end of the job."""

    def read(batches):
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                kind = kind_of(p, data)
                try:
                    rows.append((p, kind, text_of(kind, data), None))
                except BROKEN as e:
                    rows.append((p, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, kind string, text string, error string")
