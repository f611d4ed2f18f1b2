"""Functions that SQL can't express, against brute force and hand-made cases."""

import datetime as dt
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import chunking as C
from quillmill.functions import text as T
from quillmill.functions.filters import market_scope, time_window, traffic
from quillmill.sources import files, sinks
from quillmill.streaming import state as S


@given(st.text(alphabet="ab .\n", max_size=3000), st.integers(100, 900), st.integers(0, 600))
@settings(max_examples=60, deadline=None)
def test_chunks_cover_the_text(text, most, overlap):
    found = C.bounded_chunks(text, most, overlap)
    assert all(0 < e - s <= max(most, 200) for s, e in found)
    at = 0
    for s, e in found:
        assert s <= at < e
        at = e
    assert at == len(text) or not text


def test_chunk_of_exactly_the_longest_size_is_one():
    assert C.bounded_chunks("x" * 2000, 2000, 200) == [(0, 2000)]


def test_sections_follow_headings():
    text = "intro " * 10 + "\n1.1 First part\n" + "body " * 20 + "\nALL CAPITALS HERE\n" + "more " * 20
    assert [(n, t) for n, t, _, _ in C.sections(text)] == [("", ""), ("1.1", "First part"), ("", "ALL CAPITALS HERE")]


def test_numbers_need_their_subject():
    evidence = "The delivery fee is 4,50 euro for parcels."
    assert C.supported(C.numeric_claims("The delivery fee is 4.50.")[0], "The delivery fee is 4.50.", evidence)
    assert not C.supported(C.numeric_claims("The storage cost is 4.50.")[0], "The storage cost is 4.50.", evidence)
    assert C.without_unsupported("Fine words. The storage cost is 9.", evidence) == "Fine words."
    assert C.numeric_claims("1. item\n[2] note") == []


def test_directory_fields():
    assert C.directory_fields("Phone: 12\n  34\nCity: Bern\n\nstray") == {"phone": "12 34", "city": "Bern"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("card 4111 1111 1111 1111 ok", "card [PAYMENT_CARD] ok"),
        ("id 123-45-6789", "id [GOVERNMENT_ID]"),
        ("pay DE89 3704 0044 0532 0130 00 now", "pay [BANK_ACCOUNT] now"),
        ("mail a.b@c.org", "mail [EMAIL]"),
        ("call +41 44 123 45 67", "call [PHONE]"),
    ],
)
def test_redaction(text, want):
    assert T.redact(text) == want


def test_bad_checksums_stay():
    assert not T.luhn("4111111111111112")
    assert not T.valid_iban("DE89 3704 0044 0532 0130 01")


def test_sanitiser():
    assert T.sanitise('<p onclick="x">a<script>b</script><a href="javascript:x">c</a>') == "<p>a<a>c</a></p>"
    assert T.sanitise('<a href="https://x.y" target="_blank">z</a>&lt;') == '<a href="https://x.y" target="_blank" rel="noopener noreferrer">z</a>&lt;'


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=200, deadline=None)
def test_distance(a, b):
    d = T.osa_distance(a, b, 9)
    assert d == T.osa_distance(b, a, 9) and (d == 0) == (a == b) and d <= max(len(a), len(b))


def test_distance_counts_swaps_once():
    assert T.osa_distance("ca", "ac", 3) == 1 and T.osa_distance("ca", "abc", 3) == 3 and T.osa_distance("abcdef", "x", 2) == 3


def test_text_columns(spark):
    df = spark.createDataFrame([("Größe ﬁne  ok", "3-5, 9,4", "See section 4-2.", "De-CH")], "a string, p string, s string, l string")
    row = df.select(
        T.folded("a").alias("f"), T.without_accents("a").alias("w"), T.expanded_pages(F.col("p")).alias("p"), T.section_reference(F.col("s")).alias("s"), T.locale_key(F.col("l")).alias("l"),
        T.tokens(F.col("a")).alias("t"), T.unbalanced(F.lit("(a")).alias("u"), T.slug(F.lit("--")).alias("none"),
    ).first()
    assert row["f"] == "grösse fine ok" and row["w"] == "Große fine  ok"
    assert row["p"] == [3, 4, 5, 9] and row["s"] == "4.2" and row["l"] == "de" and row["t"][0] == "größe"
    assert row["u"] is True and row["none"] == "document"


def test_filters_reject_what_they_must(spark):
    one = spark.range(3).withColumn("c", F.lit("x"))
    assert one.filter(market_scope(F.col("c"), None, set())).count() == 0
    assert one.filter(market_scope(F.col("c"))).count() == 3
    with pytest.raises(ValueError):
        traffic(F.col("c"), "nowhere")
    with pytest.raises(ValueError):
        time_window(F.col("c"), dt.datetime(2024, 1, 1), start=dt.datetime(2024, 2, 1))


def brute_log(times, window, limit):
    out, kept = [], []
    for t in times:
        ok = sum(t - window < x for x in kept) < limit
        kept += [t] * ok
        out.append(ok)
    return out


def test_rate_limit_matches_brute_force(spark, small):
    from quillmill.sources.views import table

    got = {r["event_id"]: r["allowed"] for r in S.rate_limit_log(spark, small).collect()}
    e = table(spark, small, "events").toPandas().sort_values(["ts", "event_id"])
    e["t"] = e["ts"].astype("int64") / (1e9 if e["ts"].dtype == "datetime64[ns]" else 1e6)
    for _, rows in e.groupby("user_id"):
        assert [got[i] for i in rows["event_id"]] == brute_log(rows["t"].tolist(), S.WINDOW_S, S.LIMIT)


def test_burst_of_limit_and_one_more():
    assert list(S.allow([0, 0, 0], [], 10, 2)) == [True, True, False]
    assert list(S.allow([0, 10], [], 10, 1)) == [True, True]


def test_breaker_opens_and_recovers():
    assert list(S.breaker([(0, True), (1, True), (2, False), (11, False)], [0.0, 0.0], 2, 10)) == [True, True, False, True]


def test_circuits_stay_open_over_midnight(spark):
    day = 86_400.0
    rows = [(1, 1, day - 7200, True), (1, 2, day - 7100, True), (1, 3, day + 10, False), (1, 4, day + S.OPEN_S, False), (2, 5, day - 10, True), (2, 6, day + 10, True), (2, 7, day + 20, False), (3, 8, None, True)]
    got = {r["event_id"]: r["closed"] for r in S.circuit_states(spark.createDataFrame(rows, "user_id long, event_id long, t double, failed boolean")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False, 8: None}


def test_streams(spark, small, tmp_path):
    from quillmill.sources.views import table

    src = str(tmp_path / "in")
    e = table(spark, small, "events").select("user_id", "event_id", S._seconds().alias("t"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    late = "1 second"
    calls = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    waiting = {r["event_id"] for r in e.filter(F.col("t") > e.agg(F.max("t")).first()[0] - 1).collect()}
    for name, started, batch in (("limited", S.rate_limited_stream(calls, late), S.rate_limit_log), ("circuits", S.circuit_stream(calls, late), S.circuit_breaker)):
        q = started.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {tuple(r) for r in spark.table(name).collect()}
        want = {tuple(r) for r in batch(spark, small).collect()}
        assert got <= want and {i for i, _ in want - got} <= waiting  # the last second is still open
    q = S.alarm_stream(stream).writeStream.format("memory").queryName("alarms").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("alarms").agg(F.sum("total")).first()[0] == e.count()


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"section_id":"1","content":"x"}\n\n{"section_id":"2","content":"y"}\n')
    assert files.read_sections(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.csv").write_text("p,q\nr,s\n")
    assert [r[0] for r in files.read_csv_pages(spark, str(tmp_path / "b.csv")).collect()] == ["p | q", "r | s"]
    box = tmp_path / "box"
    box.mkdir()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(box / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (box / "p.pdf").write_bytes(b"%PDF-1.4")
    (box / "t.txt").write_bytes("naïve".encode("cp1252"))
    got = {r["path"].rsplit("/", 1)[-1]: (r["kind"], r["text"]) for r in files.read_files(spark, str(box)).collect()}
    assert got == {"d.docx": ("docx", "one\ntwo"), "p.pdf": ("pdf", None), "t.txt": ("txt", "naïve")}
    rows = spark.createDataFrame(pd.DataFrame({"topic": ["=1+1", "b\x01"], "content": ["u", "v"]}))
    sinks.export_csv(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == list(sinks.EXPORT_COLUMNS)
    assert "<t>=1+1</t>" in sinks.sheet_xml(rows, ("topic",)) and "\x01" not in sinks.sheet_xml(rows, ("topic",))
    sinks.write_sections(rows, str(tmp_path / "pack"))
    assert spark.read.json(str(tmp_path / "pack/jsonl")).count() == 2

    def broken(_):
        raise RuntimeError("no")

    seen = []
    assert len(sinks.fan_out(rows, [broken, lambda b: seen.append(b.count())])) == 1 and seen == [2]


def test_repairs():
    from quillmill.functions import repair as R

    assert R.repaired_query("delivry of B12 ABC parcels", ["delivery", "parcel"]) == "delivery of B12 ABC parcel"
    assert R.repaired_query("returnpolicy", ["return", "policy"]) == "return policy"
    assert R.scrubbed("call Ann Lee at 555", [(5, 12, "NAME"), (16, 19, "PHONE")], "ann-lee works here") == "call Ann Lee at [PHONE]"
    assert R.joined_characters("h e l l o  w o r l d") == "hello world"
    assert R.phrase_intent("thanks and hello", ["hello", "thanks"]) and R.phrase_intent("helo", ["hello"]) and not R.phrase_intent("hello friend", ["hello"])


def test_tables_and_workbooks(spark, tmp_path):
    schema = "id long, a string, b string, updated_at int"
    now = spark.createDataFrame([(1, "a", "b", 1)], schema)
    new = spark.createDataFrame([(1, "c", "d", 2), (2, "e", "f", 2)], schema)
    assert sorted(map(tuple, sinks.upsert(now, new, "id", first=("a",)).collect())) == [(1, "a", "d", 2), (2, "e", "f", 2)]
    assert sorted(map(tuple, sinks.insert_new(now, new, "id").collect())) == [(1, "a", "b", 1), (2, "e", "f", 2)]
    assert [r["errors"] for r in sinks.checked_rows(new, {"small": F.col("id") < 2}).orderBy("id").collect()] == [[], ["small"]]
    root = str(tmp_path / "gen")
    assert sinks.publish_generation(now, root, "g1", 1).count() == 1
    with pytest.raises(ValueError):
        sinks.publish_generation(new, root, "g2", 5)
    assert sinks.active_generation(spark, root).count() == 1
    (tmp_path / "plans").mkdir()
    sinks.write_xlsx(new, str(tmp_path / "plans" / "p.xlsx"), ("id", "a"))
    plans = files.read_plans(spark, str(tmp_path / "plans"), {"test id": ("ID",), "answer": ("a",), "none": ()})
    assert sorted((r["test id"], r["answer"], r["none"]) for r in plans.collect()) == [("1", "c", ""), ("2", "e", "")]
    blocks = spark.createDataFrame([("d", 1, 2, "LINE", "two"), ("d", 1, 1, "LINE", "one"), ("d", 1, 1, "WORD", "x")], "document string, page int, line int, kind string, text string")
    assert files.recognised_pages(blocks).first()["text"] == "one\ntwo"


def test_packages_and_changes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "text one", "en"), ("b", "text two", "de")], "section_id string, content string, language string")
    assert sinks.write_packages(rows, str(tmp_path / "p")).first()["texts"] == 2
    assert sinks.complete(rows, str(tmp_path / "p"))
    new = spark.createDataFrame([("a", "text one", "en"), ("b", "text 2", "de"), ("c", "x", "fr")], rows.schema)
    assert sorted(r["section_id"] for r in sinks.changes_only(new, rows, "section_id", "content").collect()) == ["b", "c"]
