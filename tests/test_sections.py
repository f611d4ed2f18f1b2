"""Sections, parts and children: given documents, and what holds for all."""

import collections
import random
import re

import pytest

from quillmill.functions import sectioning
from quillmill.operators.documents import preflight_profile
from quillmill.operators.sections import document_sections, section_profiles, section_rows
from quillmill.sources.views import table

POLICY = [
    "Handbook of the Harbour\nValid from 2024",
    "Contents\n1 Purpose ........ 3\n1.1 Scope ........ 3\n2 Fees ........ 4\n2.1 Discounts ........ 4\n2.2 Refunds ........ 5\n3 Notices ........ 6",
    "1.1 Scope\nThis holds for all berths and for those who rent them.\nBerth: a place at a quay that is let by the day or year.\nGuest: whoever stays under a month.\n7",
    "2.1 Discounts\n(a) Members of the club pay a fifth less than others do.\n(b) Boats under six metres pay half of the listed fee.\n(c) short\n2.2 Refunds\nWhat is paid back:\nBefore 30 days 100 percent\nBefore 7 days 50 percent\nLater 0 percent of the fee",
    "2.1 Discounts\nThis annex has a second part on discounts for the winter.",
]


def of(pages, profile="next"):
    return {s.section_id: s for s in sectioning.sectioned(pages, profile)}


def test_a_policy_becomes_rows_with_parents():
    rows = of(POLICY)
    assert {i: (s.kind, s.parent) for i, s in rows.items()} == {
        "front-matter-page-1": ("document_front_matter", ""), "outline-page-2": ("document_outline", ""), "page-1": ("page_block", ""),
        "1.1": ("section", ""), "1.1-definition-1": ("definition", "1.1"), "1.1-definition-2": ("definition", "1.1"),
        "2.1": ("section", ""), "2.1-a": ("list_item", "2.1"), "2.1-b": ("list_item", "2.1"),
        "2.2": ("section", ""), "2.2-definition-1": ("definition", "2.2"), "2.2-fact-2": ("numeric_fact", "2.2"), "2.2-fact-3": ("numeric_fact", "2.2"), "2.2-fact-4": ("numeric_fact", "2.2"),
        "2.1-occurrence-2": ("section", ""),
    }
    assert rows["1.1-definition-2"].content == "Section 1.1: Scope\nGuest: whoever stays under a month." and rows["1.1-definition-1"].title == "Berth"
    assert (rows["2.1"].first_page, rows["2.1-occurrence-2"].first_page, rows["1.1"].last_page) == (4, 5, 3)
    assert rows["2.2-fact-3"].content == "Section 2.2: Refunds\nBefore 7 days 50 percent"
    assert rows["2.1-a"].content.endswith("than others do.")


def random_text(r, n):
    return "".join(r.choice(["word ", "longer-word ", "x", ". ", "\n", "\n\n", "  ", "1.2 Title of it\n"]) for _ in range(n))


@pytest.mark.parametrize("profile", list(sectioning.PROFILES))
def test_parts_keep_every_word_in_order_and_are_bounded(profile):
    most, overlap = sectioning.PROFILES[profile]
    r = random.Random(profile)
    for text in [random_text(r, n) for n in (10, 600, 3000, 6000)] + ["y" * 20_000, "a b " * 6000, "\n" * 9000 + "z"]:
        at, done = 0, 0
        for start, part in sectioning.parts(text, profile):
            assert part == part.strip() and 0 < len(part) <= most and text[start:].lstrip().startswith(part)
            begin = text.index(part, start)
            assert not text[done:begin].strip()  # nothing but white space is left out
            assert start >= at and done - begin <= overlap
            at, done = start, max(done, begin + len(part))
        assert not text[done:].strip()


def test_breaks_lie_in_the_second_half():
    text = "a" * 1500 + "\n\n" + "b" * 300 + ". " + "c" * 1000
    first, second = list(sectioning.parts(text, "next"))
    assert first[1] == text[:1803] and second[1].endswith("c" * 1000)
    early = "a" * 400 + "\n" + "b" * 3000
    assert len(next(sectioning.parts(early, "next"))[1]) == 2000 and next(sectioning.parts(early + "b" * 6000, "current"))[1] == "a" * 400


@pytest.mark.parametrize("profile", list(sectioning.PROFILES))
def test_rows_of_random_documents(profile):
    r = random.Random(11)
    for _ in range(60):
        pages = [random_text(r, r.randint(0, 900)) for _ in range(r.randint(1, 4))]
        rows = list(sectioning.sectioned(pages, profile))
        assert max(collections.Counter(s.section_id for s in rows).values(), default=1) == 1
        ids = {s.section_id for s in rows}
        for s in rows:
            assert 1 <= s.first_page <= s.last_page <= len(pages) and len(s.title) <= sectioning.TITLE
            if profile == "next":
                assert len(s.content) <= sectioning.PROFILES["next"][0]
            if s.kind in ("list_item", "numeric_fact") and "-part-" not in s.section_id:
                assert s.parent in ids or any(i.startswith(s.parent) for i in ids)


def test_tables_are_cut_whole(spark, small):
    docs = table(spark, small, "documents")
    rows = document_sections(spark, small).collect()
    want = {(r["doc_id"], s.section_id) for r in docs.collect() for s in sectioning.sectioned((r["text"] or "").split("\f"), "next")}
    assert {(r["doc_id"], r["section_id"]) for r in rows} == want and len(rows) == len(want)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.filter("trim(text) <> ''").collect()}
    both = section_profiles(spark, small).collect()
    assert {r["profile"] for r in both} == {"current", "next"} and all(r["most_chars"] <= 2000 for r in both if r["profile"] == "next")
    assert section_rows(spark.createDataFrame([(1, None), (2, " \n")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="unknown profile"):
        section_rows(docs, "none")


def test_preflight_equals_a_plain_look_at_each_line(spark, tmp_path):
    def plain(text):
        lines = [x for x in text.split("\n") if x.strip()]
        rows = sum(bool(re.search(r"\S(?:\s*\||\t| {3,})\s*\S.*(?:\||\t| {3,})", x)) for x in lines)
        return rows >= 3 and rows >= 0.12 * len(lines), sum(not c.isspace() for c in text) >= 40

    r = random.Random(9)
    pieces = ["a", "b|", "|", "\t", "   ", " ", "\n", "é", "　", "\xa0", "日本", "x | y | z\n", "k\tv\tw\n"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "a | b | c\n" * 3, "a | b | c\n" * 3 + "x\n" * 22, "a | b | c\n" * 3 + "x\n" * 23, "x" * 39, "x" * 40]
    rows = [(n, t) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: (x["table_like"], x["text_page"]) for x in preflight_profile(spark, str(tmp_path)).collect()}
    assert got == {n: plain(t or "") for n, t in rows}
