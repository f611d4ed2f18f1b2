"""Directory records and the repair of answers by them, case by case."""

import pytest
from pyspark.sql import functions as F

from quillmill.operators import directory

RECORD = """Harbour Office North
Country
Norland
Address
12 Quay Street
Port Town
Telephone Office +12 34 567 89
Telephone for orders: +12 00 000 00
Fax
none
Email
north@harbour.example
Business Hours Office
Monday to Friday
8 to 5
Minimum order size FBO: 2 CC, which is around 310,50 EUR in shops.
Fax
+12 34 567 80"""


def test_fields_of_a_record(spark):
    rows = spark.createDataFrame([(RECORD,), ("Title only",), ("",), (None,), ("T\nstray line\nPhone 2 # 77\nWebsite\n\nEmail\n",)], "record string")
    got = [[(f["label"], f["value"]) for f in r[0]] for r in rows.select(directory.fields(F.col("record"))).collect()]
    assert got[0] == [
        ("Country", "Norland"), ("Address", "12 Quay Street Port Town"), ("Telephone Office", "+12 34 567 89"), ("Telephone for orders", "+12 00 000 00"), ("Fax", "+12 34 567 80"),
        ("Email", "north@harbour.example"), ("Business Hours Office", "Monday to Friday 8 to 5 Minimum order size FBO: 2 CC, which is around 310,50 EUR in shops."),
    ]
    assert got[1:] == [[], [], [], [("Phone 2", "77")]]


CASES = [
    ("with_contacts", ("Write to NORTH@harbour.example.",), "Write to NORTH@harbour.example.\n\nAddress: 12 Quay Street Port Town\nTelephone Office: +12 34 567 89\nTelephone for orders: +12 00 000 00\nFax: +12 34 567 80"),
    ("with_contacts", ("No idea.",), "No idea."),
    ("with_contacts", ("",), ""),
    ("with_asked_hours", ("We are glad to help.", "When are the business hours?"), "We are glad to help.\n\nBusiness Hours Office: Monday to Friday 8 to 5 Minimum order size FBO: 2 CC, which is around 310,50 EUR in shops."),
    ("with_asked_hours", ("", "Where is it?"), ""),
    ("only_asked", ("Telephone Office: 1\nTelephone for orders: 2\nEmail: x@y.example", "the phone please"), "Telephone Office: 1"),
    ("only_asked", ("Address: a\nEmail: x@y.example\n\n\n\nBye", "their e-mail?"), "Email: x@y.example\n\n\nBye".replace("\n\n\n", "\n\n")),
    ("only_asked", ("Address: a\nEmail: b", "all contact data by email"), "Address: a\nEmail: b"),
    ("only_asked", ("Address: a\nEmail: b", "hello"), "Address: a\nEmail: b"),
    ("only_asked", ("It is 2 CC. Delivery cost is 5. Business hours are long.", "What is the minimum order size?"), "It is 2 CC."),
    ("with_role", ("The minimum order size is 2 CC; the minimum order size is small.",), "The FBO minimum order size is 2 CC; the minimum order size is small."),
    ("with_role", ("The FBO minimum order size is 2 CC.",), "The FBO minimum order size is 2 CC."),
    ("with_order_size", ("It depends.", "the minimum order size?"), "It depends.\n\nMinimum order size FBO: 2 CC, which is around 310,50 EUR in shops."),
    ("with_order_size", ("It depends.", "and the phone?"), "It depends."),
    ("without_contradiction", ("You need 2 cc, around 999 EUR today.",), "You need 2 cc, around 310,50 EUR today."),
    ("without_contradiction", ("You need 3 CC, around 999 EUR today.",), "You need 3 CC, around 999 EUR today."),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_each_repair(spark, k):
    name, given, want = CASES[k]
    df = spark.createDataFrame([(given[0], given[1] if len(given) > 1 else "", RECORD)], "a string, q string, r string")
    a, q, r = F.col("a"), F.col("q"), F.col("r")
    known = directory.fields(r)
    calls = {"with_contacts": (a, known), "with_asked_hours": (a, known, q), "only_asked": (a, q), "with_role": (a, r), "with_order_size": (a, r, q), "without_contradiction": (a, r)}
    assert df.select(getattr(directory, name)(*calls[name])).first()[0] == want


def test_minimum_after_sponsorship(spark):
    df = spark.createDataFrame([("After sponsorship: 3 CC are needed. Bye.", "After sponsorship we do not have a minimum order")], "a string, r string")
    assert df.select(directory.without_contradiction(F.col("a"), F.col("r"))).first()[0] == "After sponsorship: there is no minimum order. Bye."


def test_digits_and_nulls(spark):
    df = spark.createDataFrame([("Ring 12-3456789 now", "q", RECORD), (None, None, None)], "answer string, question string, record string")
    a, b = directory.repaired(df).collect()
    assert a["repaired"].startswith("Ring 12-3456789 now\n\nAddress: ") and "Telephone Office" not in a["repaired"]
    assert b["repaired"] == "" and b["known"] == []


def test_records_of_a_directory(spark):
    text = "Source worksheet: 1\nNorth Office\nCountry\nNorland\nEmail\nnorth@har\nbour.example\nSouth\nCountry\nSudland\nFax 1\nAnn  Bell\nOperating Country\nNorland\nTitle\nHead\nEast!\nCountry\nEastland"
    got = spark.createDataFrame([(text,), (None,), ("Country\nX",)], "t string").select(directory.records(F.col("t"))).collect()
    assert [(r["kind"], r["title"], r["country"], r["record_id"]) for r in got[0][0]] == [
        ("office", "North Office", "Norland", "office-001-north-office"), ("office", "South", "Sudland", "office-002-south"),
        ("staff", "Ann Bell", "Norland", "staff-001-ann-bell"), ("office", "East!", "Eastland", "office-003-east"),
    ]
    assert got[0][0][0]["content"] == "North Office\nCountry\nNorland\nEmail\nnorth@harbour.example" and got[1][0] == got[2][0] == []
