"""What an approved text holds stays; other personal data is masked."""

import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import scrub
from quillmill.sources.views import table

APPROVED = "Our Quay Office 706 -\n709, Port Town. Call +49 (30) 123-4567 or write to Info@Harbour.example. Director: Ann Maria Bell of the North."


def held(entity, approved):
    """The rule once more, in plain words."""
    e, a = entity.lower().strip(), (approved or "").lower()
    flat = lambda x: re.sub(r"[^\w]+", " ", x).strip()
    number = lambda x: re.sub(r"\D", "", x)
    own, other = (set(re.findall(r"[^\W_]+", x)) for x in (e, a))
    return bool(e) and (e in a or bool(flat(e)) and flat(e) in flat(a) or len(number(e)) >= 7 and number(e) in number(a) or len(own) >= 2 and len(own & other) >= 2 and len(own & other) / len(own) >= 0.8)


CASES = ["info@harbour.EXAMPLE", "other@harbour.example", "706-709", "030 1234567", "30 123 45 67", "49 301 234", "", " ", "--", "Bell Ann Maria North x", "Bell Ann x y", "Ann Bell", "Zoe", "Port Town office Quay Street"]


def test_what_is_grounded(spark):
    df = spark.createDataFrame([(c, APPROVED) for c in CASES] + [("x", None)], "e string, a string")
    got = [r[0] for r in df.select(scrub.grounded(F.col("e"), scrub.approved_forms(F.col("a")))).collect()]
    assert got == [held(c, APPROVED) for c in CASES] + [False] and 4 < sum(got) < len(got) - 4


def test_patterns(spark):
    rows = [
        ("Mail info@harbour.example, me@home.example or +49 30 1234567, not 0171 2345678.", APPROVED, "Mail info@harbour.example, [EMAIL] or +49 30 1234567, not [PHONE]."),
        ("Card 4111 1111 1111 1111 and id 123-45-6789", "4111 1111 1111 1111 123-45-6789", "Card [PAYMENT_CARD] and id [GOVERNMENT_ID]"), ("a@b.example", None, "[EMAIL]"), ("nothing", APPROVED, "nothing"), (None, APPROVED, ""), ("a@b.example c@d.example", "A@B.example", "a@b.example [EMAIL]"),
    ]
    df = scrub.scrubbed_patterns(spark.createDataFrame(rows, "t string, a string, want string"), "t", "a")
    assert [(r["scrubbed"]) for r in df.collect()] == [w for _, _, w in rows]


@pytest.mark.parametrize(("options", "want"), [
    ({}, "[NAME] lives at [ADDRESS] in [LOCATION]; Ann Bell of Port Town wrote [PII]."),
    ({"keep_places": True}, "[NAME] lives at [ADDRESS] in New Haven; Ann Bell of Port Town wrote [PII]."),
    ({"keep_people": True}, "Zoe Smith lives at [ADDRESS] in [LOCATION]; Ann Bell of Port Town wrote [PII]."),
    ({"names": "zoe smith"}, "Zoe Smith lives at [ADDRESS] in [LOCATION]; Ann Bell of Port Town wrote [PII]."),
])
def test_spans(spark, options, want):
    text = "Zoe Smith lives at 5 Elm Road in New Haven; Ann Bell of Port Town wrote secretly."
    place = lambda x: (text.index(x), text.index(x) + len(x))
    spans = [(*place("secretly"), None), (*place("Zoe Smith"), "name"), (*place("5 Elm Road"), "ADDRESS"), (*place("Elm"), "NAME"), (*place("New Haven"), "LOCATION"), (*place("Ann Bell"), "NAME"), (*place("Port Town"), "LOCATION")]
    df = spark.createDataFrame([(text, spans, APPROVED), (text, [], APPROVED)], "t string, s array<struct<start:int,stop:int,kind:string>>, a string")
    names = scrub.approved_forms(F.lit(options["names"])) if "names" in options else None
    rest = {k: v for k, v in options.items() if k != "names"}
    got = [r[0] for r in df.select(scrub.scrubbed_spans(F.col("t"), F.col("s"), scrub.approved_forms(F.col("a")), names, **rest)).collect()]
    assert got == [want, text]


def test_marks(spark):
    rows = [("Write to us [EMAIL], [PHONE] .\n[NAME]: x\nBye ( [NAME] ) now", "Write to us.\nBye now"), ("No marks  here", "No marks  here"), ("[NAME]", ""), ("Keep [this] !", "Keep [this]!")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r[0] for r in df.select(scrub.without_marks(F.col("t"))).collect()] == [w for _, w in rows]
    df = spark.createDataFrame([("a [payment_card] b",), ("[EMAIL]",), ("none",)], "t string")
    assert [r[0] for r in df.select(scrub.sensitive(F.col("t"))).collect()] == [True, False, False]


def test_whole_table(spark, small):
    docs = table(spark, small, "documents").collect()
    first = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        first.setdefault(r["source"], r["text"])
    mail, phone = (re.compile(p) for p, label, _ in T.REDACTED if label in scrub.KEPT_IF_GROUNDED)
    want = {}
    for r in docs:
        x = T.redact(r["text"], scrub.ALWAYS)
        for pattern, label in ((mail, "[EMAIL]"), (phone, "[PHONE]")):
            x = pattern.sub(lambda m: m[0] if held(m[0], first[r["source"]]) else label, x)  # noqa: B023
        want[r["doc_id"]] = hashlib.sha256(x.encode()).hexdigest()
    got = scrub.grounded_scrub(spark, small).collect()
    assert {r["doc_id"]: r["scrubbed_hash"] for r in got} == want and sum(r["marks"] for r in got) > 5


@pytest.mark.parametrize("name", ["html_sanitize", "grounded_scrub"])
def test_python_gets_small_batches(spark, small, name):
    """After a query is made, a worker gets few rows at a time, and fewer where they are long."""
    from quillmill.plans.catalogue import queries

    @F.pandas_udf("long")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    for key in ("Records", "Bytes"):
        spark.conf.unset(f"spark.sql.execution.arrow.max{key}PerBatch")
    queries()[name](spark, small)
    texts = lambda n, size: spark.range(n, numPartitions=1).select(rows(F.repeat(F.col("id").cast("string"), size)).alias("n"))
    assert max(r["n"] for r in texts(3000, 1).collect()) <= 500
    assert max(r["n"] for r in texts(200, 100_000).collect()) <= 50
