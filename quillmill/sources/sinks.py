"""Writers: exports, packages, and bounded batches of a stream."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_COLUMNS = ("created_at", "correlation_id", "session_id", "country", "language", "traffic_source", "topic", "confidence", "tokens", "fallback", "rating")
MOST_SHEET_ROWS = 5_000


def export_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = EXPORT_COLUMNS) -> None:
    """The columns in their fixed order, with a header; further ones are left out, absent ones empty."""
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*have).write.mode("overwrite").option("header", True).csv(path)


def write_sections(rows: DataFrame, path: str) -> None:
    """JSON lines, and CSV with the content's length and preview."""
    rows.write.mode("overwrite").json(f"{path}/jsonl")
    rows.withColumn("content_length", F.length("content")).withColumn("preview", F.substring("content", 1, 300)).drop("content").write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def sheet_xml(rows: DataFrame, columns: tuple[str, ...]) -> str:
    """One sheet of inline strings: no cell can be a formula, control characters go; a longer report than a sheet may have fails."""
    cells = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).limit(MOST_SHEET_ROWS + 1).collect()
    if len(cells) > MOST_SHEET_ROWS:
        raise ValueError(f"a report has at most {MOST_SHEET_ROWS} rows; export longer ones as CSV")
    clean = lambda x: escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", x))
    lines = [columns, *cells]
    return "<worksheet><sheetData>" + "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{clean(str(x))}</t></is></c>' for x in r) + "</row>" for r in lines) + "</sheetData></worksheet>"


def fan_out(batch: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> list[str]:
    """Give a batch to each sink; what one says when it fails doesn't stop the others."""
    failed = []
    for sink in sinks:
        try:
            sink(batch)
        except Exception as error:  # noqa: BLE001
            failed.append(f"{getattr(sink, '__name__', 'sink')}: {error}")
    return failed


def numbered_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows with the number of their batch of ``size``, in order of a unique long id that starts near 0."""
    return rows.withColumn("batch", F.expr(f"`{order}` div {size}"))


def upsert(current: DataFrame, updates: DataFrame, key: str, first: tuple[str, ...] = (), order: str = "updated_at") -> DataFrame:
    """The table after an upsert: the newest value of each column, but the oldest of those in ``first``; one row a key."""
    rows = current.unionByName(updates)
    out = [(F.min_by if c in first else F.max_by)(c, order).alias(c) for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*out, F.max(order).alias(order)).select(*current.columns)


def insert_new(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows whose key is new are added; known ones are ignored."""
    return current.unionByName(updates.dropDuplicates([key]).join(current.select(key), key, "left_anti").select(*current.columns))


def checked_rows(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``errors``: the names of the rules that each breaks; nothing is raised."""
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def publish_generation(rows: DataFrame, root: str, generation: str, expected: int) -> DataFrame:
    """Write a generation beside the others, count it, and only then let the pointer name it.

    A wrong count leaves the pointer as it was.  A generation that a pointer has named is never written again, since
    readers may hold it.  A pointer's number is a folder that must not exist yet: a writer that finds it taken
    claims the next one, and should two writers make one at the same moment, the later name counts.
    Returns the rows of the active generation.
    """
    spark = rows.sparkSession
    path = f"{root}/generation={generation}"
    known = _pointers(spark, root)
    if known is not None and not known.filter(F.col("generation") == generation).isEmpty():
        raise ValueError(f"generation {generation} was published before")
    rows.write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path).count()
    if found != expected:
        raise ValueError(f"{found} rows were written and {expected} expected")
    # pointers are only ever added, and a write that breaks off is never seen, so some generation is active at all times
    newest = _pointers(spark, root)
    number = (newest.agg(F.max("number")).first()[0] or 0) + 1 if newest is not None else 1
    pointer = spark.range(1).select(F.lit(generation).alias("generation"), F.lit(found).cast("long").alias("n")).coalesce(1)
    while True:
        try:
            pointer.write.mode("errorifexists").json(f"{root}/pointer/number={number}")
            break
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number += 1
    return active_generation(spark, root)


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    """All pointers that were ever written, or None before the first one."""
    try:
        return spark.read.schema("number long, generation string, n long").json(f"{root}/pointer")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def active_generation(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the generation that the newest pointer names."""
    name = _pointers(spark, root).orderBy(F.desc("number"), F.desc("generation")).first()["generation"]
    return spark.read.parquet(f"{root}/generation={name}")


def write_xlsx(rows: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """A workbook of one sheet, for a report of at most MOST_SHEET_ROWS rows."""
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Report" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet_xml(rows, columns).replace("<worksheet>", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'),
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


def write_packages(rows: DataFrame, path: str, key: str = "section_id") -> DataFrame:
    """A text for each section in a folder of its own, a sidecar of metadata beside it, and a manifest; returns the manifest."""
    rows.select(key, "content").write.mode("overwrite").partitionBy(key).text(f"{path}/text")
    rows.withColumn("content_hash", F.sha2("content", 256)).drop("content").repartition(key).write.mode("overwrite").partitionBy(key).json(f"{path}/meta")
    manifest = rows.agg(F.count("*").alias("texts"), F.count_distinct(key).alias("sections"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return rows.sparkSession.read.json(f"{path}/manifest")


def complete(rows: DataFrame, path: str, key: str = "section_id") -> bool:
    """Does a package have as many texts as sidecars, and any?"""
    spark = rows.sparkSession
    texts, sidecars = spark.read.text(f"{path}/text", wholetext=True).count(), spark.read.json(f"{path}/meta").count()
    return texts == sidecars > 0


def changes_only(updates: DataFrame, seen: DataFrame, key: str, payload: str) -> DataFrame:
    """Of a batch of updates those whose payload differs from what was last emitted for their key."""
    before = seen.select(key, F.sha2(F.col(payload), 256).alias("_seen"))
    return updates.join(before, key, "left").filter(~F.col("_seen").eqNullSafe(F.sha2(F.col(payload), 256))).drop("_seen")
