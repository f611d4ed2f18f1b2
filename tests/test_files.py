"""Inspection of delivered files, broken files, plans as tables of text, and texts read in the wrong encoding."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.functions.repair import repaired_encoding
from quillmill.sources import files, inspection, sinks

PARTS = {"[Content_Types].xml": "<t/>", "word/document.xml": "<d/>"}


def archive(parts, how=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_each_file_has_its_first_problem(spark, tmp_path):
    limits = inspection.Limits(size=4000, expansion=4, ratio=20)
    cases = {
        "a.txt": (b"words", "text", None), "b.md": (b"x\0y", None, "binary"), "c.txt": (b"%PDF-1.4", "pdf", "mismatch"), "d.exe": (b"MZ", None, "unsupported"), "noname": (b"x", None, "unsupported"),
        "f.csv": (b"x" * 4001, None, "too_large"), "g.pdf": (b"%PDF-1.4 fine", "pdf", None), "h.pdf": (b"%PDF-1.4 /JavaScript", "pdf", "active_content"), "i.pdf": (b"text", "text", "mismatch"),
        "j.DOCX": (archive(PARTS), "docx", None), "k.docx": (b"text", "text", "mismatch"), "l.docx": (archive({"word/document.xml": "x"}), "docx", "incomplete"),
        "m.docx": (archive(PARTS | {"word/vbaProject.bin": "x"}), "docx", "macros"), "n.docx": (archive(PARTS | {"x": "0" * 17000}), "docx", "expands_too_far"), "o.docx": (archive(PARTS | {"x": "0" * 15000}), "docx", "ratio"),
        "p.docx": (archive(PARTS | {"word/_rels/a.rels": '<r TargetMode="External"/>'}), "docx", "external_links"), "q.htm": (b"x" * 8192 + b"\0", None, "too_large"),
    }
    for name, (data, _, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "e.txt").write_bytes(b"")  # no row: Spark's readers pass over it
    got = {r["path"].rsplit("/", 1)[-1]: (r["family"], r["problem"]) for r in inspection.inspected(spark, str(tmp_path), limits=limits).collect()}
    assert got == {name: (family, problem) for name, (_, family, problem) in cases.items()}


def test_an_archive_with_a_broken_member_is_told():
    data = bytearray(archive(PARTS | {"word/_rels/a.rels": "<r/>" * 50}, zipfile.ZIP_STORED))
    at = data.index(b"<r/><r/>")
    data[at] = 0  # the check sum no longer fits
    assert inspection.archive_problem(bytes(data)) == "broken_archive"


def test_a_broken_file_does_not_end_the_job(spark, tmp_path):
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04 not an archive")
    (tmp_path / "empty.docx").write_bytes(archive({"other.xml": "x"}))
    (tmp_path / "good.txt").write_text("words")
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"] is None) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"bad.docx": (None, False), "empty.docx": (None, False), "good.txt": ("words", True)}


def test_plans_as_tables_of_text(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes('﻿Test ID,Question\n1,"naïve, yes"\n\n2\n'.encode())
    (tmp_path / "w.csv").write_bytes("test_id,Question\n3,café\n".encode("cp1252"))
    (tmp_path / "x.xlsx").write_bytes(b"no workbook")
    plans = files.read_plans(spark, str(tmp_path), {"test id": (), "question": (), "actual response": ()})
    got = sorted((r["path"].rsplit("/", 1)[-1], r["test id"], r["question"], r["actual response"], r["error"] is None) for r in plans.collect())
    assert got == [("u.csv", "1", "naïve, yes", "", True), ("u.csv", "2", "", "", True), ("w.csv", "3", "café", "", True), ("x.xlsx", None, None, None, False)]


def test_texts_read_in_the_wrong_encoding(spark):
    misread = lambda s: s.encode().decode("latin-1")
    cases = [("café straße\nmüde" * 50,) * 2, (misread("été\nnaïve 日本"), "été\nnaïve 日本"), ("Âge", "Âge"), ("日Ã©", "日Ã©")]
    cases += [("itâ€™s â€œsoâ€�", 'it\'s "so"'), ("â€™ " + misread("é"), "' é"), ("", ""), (None, None), ("\U0001f389 Ã©", "\U0001f389 Ã©")]
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "n int, t string").repartition(3)
    assert {r["n"]: r["x"] for r in df.select("n", repaired_encoding(F.col("t")).alias("x")).collect()} == {n: want for n, (_, want) in enumerate(cases)}


def test_a_taken_pointer_number_is_passed_over(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "gen")
    make = lambda n: spark.range(n).withColumnRenamed("id", "k")
    sinks.publish_generation(make(1), root, "b", 1)
    seen = sinks._pointers
    stale = iter([None, None])  # another writer has published since this one looked
    monkeypatch.setattr(sinks, "_pointers", lambda *a: next(stale, None) if stale.__length_hint__() else seen(*a))
    assert sinks.publish_generation(make(2), root, "a", 2).count() == 2
    assert sorted((r["number"], r["generation"]) for r in seen(spark, root).collect()) == [(1, "b"), (2, "a")]
    with pytest.raises(ValueError, match="before"):
        sinks.publish_generation(make(3), root, "a", 3)
    assert sinks.active_generation(spark, root).count() == 2
