"""Test plans and model routes, case by case."""

from pyspark.sql import functions as F

from quillmill.operators import evaluation as E

ITEM = "struct<rank:int,title:string,page:string,source:string,excerpt:string,score:double>"
PLAN = f"k int, question string, expected_source string, expected_page string, test_type string, found array<{ITEM}>, candidates array<{ITEM}>"


def hit(rank=1, title="Handbook.pdf", page="3", source="s3/handbook.pdf", excerpt="on fees", score=0.4):
    return (rank, title, page, source, excerpt, score)


def test_kinds_pages_and_sections(spark):
    rows = [
        ("Handbook.pdf p 3", "", "RETRIEVAL"), ("Refusal", None, "NON_RETRIEVAL"), ("refusal", " Retrieval ", "RETRIEVAL"), ("Handbook.pdf", "Guardrail test", "NON_RETRIEVAL"), (None, None, "RETRIEVAL"), ("see N/A", "other", "NON_RETRIEVAL"),
    ]
    df = spark.createDataFrame(rows, "e string, t string, want string")
    assert [r[0] for r in df.select(E.row_kind(F.col("e"), F.col("t"))).collect()] == [w for _, _, w in rows]
    raw = [("3-5, 9.0 and 4", ["3", "4", "5", "9"]), ("5–3", ["3", "5"]), ("", []), (None, []), ("page 12", ["12"])]
    assert [r[0] for r in spark.createDataFrame(raw, "p string, w array<string>").select(E.expected_pages(F.col("p"))).collect()] == [w for _, w in raw]
    raw = [("Section 2.1b, sec. 4", ["2.1b", "4"]), ("intersection 5", []), (None, [])]
    assert [r[0] for r in spark.createDataFrame(raw, "p string, w array<string>").select(E.expected_sections(F.col("p"))).collect()] == [w for _, w in raw]


def test_the_number_of_a_section_is_no_page(spark):
    raw = [("Section 2.1", []), ("SEC. 4b, pages 3-4", ["3", "4"]), ("section 2-4", []), ("intersection 5", ["5"])]
    assert [r[0] for r in spark.createDataFrame(raw, "p string, w array<string>").select(E.expected_pages(F.col("p"))).collect()] == [w for _, w in raw]
    rows = [(0, "q", "Handbook.pdf", "Section 2.1", "", [hit(page="2")], [hit(page="2")])]
    assert [r["status"] for r in E.evaluated(spark.createDataFrame(rows, PLAN)).collect()] == ["FAIL_SECTION_NOT_FOUND"]


def test_sections_match_by_number(spark):
    cases = [(["2.1"], "part 2.1 of", True), (["2.1"], "part 2-1a", True), (["2.1b"], "see 2.1 (c)", True), (["2.1b"], "2-1", True), (["2.1"], "12.1", False), (["2.1"], "2.12", False), ([], "2.1", False), (["2.1", "7"], "in 7.", True)]
    df = spark.createDataFrame([(s, ("1", "", "", x)) for s, x, _ in cases], "s array<string>, one struct<title:string,page:string,source:string,excerpt:string>")
    assert [r[0] for r in df.select(E.section_matches(F.col("s"), F.col("one"))).collect()] == [w for _, _, w in cases]


def test_each_status(spark):
    ok, other = hit(), hit(rank=2, title="Other.pdf", page="8", source="s3/other.pdf", excerpt="2.1 (a)")
    cases = [
        (("q", "Handbook.pdf", "3-4", ""), [other, ok], [], "PASS_PAGE", [1], "FINAL_SELECTION_OK", None),
        (("q", "Handbook.pdf", "section 2.1", ""), [ok, other], [], "PASS_SECTION_HINT", [2], "FINAL_SELECTION_OK", None),
        (("q", "Handbook.pdf", "section 9.9", ""), [ok], [other], "FAIL_SECTION_NOT_FOUND", [], "EXPECTED_SECTION_NOT_IN_CANDIDATES", "Candidate retrieval miss"),
        (("q", "Handbook.pdf", "section 2.1", ""), [ok], [other], "FAIL_SECTION_NOT_FOUND", [], "EXPECTED_SECTION_IN_CANDIDATES_NOT_SELECTED", "Final selector/reranker miss"),
        (("q", "docs/handbook.pdf", "7", ""), [ok], [], "PASS_DOC_WRONG_PAGE", [1], "FINAL_SELECTION_OK", None),
        (("q", "Handbook document", "", ""), [other, ok], [], "PASS_DOC_ONLY_NEEDS_EXPECTED_PAGE", [1], "FINAL_SELECTION_OK", None),
        (("q", "Handbook.pdf", "", ""), [other], [ok], "FAIL_WRONG_SOURCE", [], "EXPECTED_SOURCE_IN_CANDIDATES_NOT_SELECTED", "Final selector/reranker miss"),
        (("q", "Handbook.pdf", "", ""), [], [other], "FAIL_NO_RESULT", [], "EXPECTED_SOURCE_NOT_IN_CANDIDATES", "Candidate retrieval miss"),
        (("And that?", "the fees", "", ""), [other], [], "FAIL_WRONG_SOURCE", [], "NO_RETRIEVAL_EXPECTATION_TO_DIAGNOSE", "Not a pure retrieval test"),
        (("Quel est le prix", "the fees", "", ""), [other], [], "FAIL_WRONG_SOURCE", [], "NO_RETRIEVAL_EXPECTATION_TO_DIAGNOSE", "Language routing or translation needed"),
        (("Whom to call", "customer care", "", ""), [hit(title="Contact us")], [], "FAIL_WRONG_SOURCE", [], "NO_RETRIEVAL_EXPECTATION_TO_DIAGNOSE", "Expected source needs confirmation"),
        (("Whom to call", "", "", ""), [other], [], "UNSCORABLE_MISSING_EXPECTED_SOURCE", [], "NO_RETRIEVAL_EXPECTATION_TO_DIAGNOSE", "True retrieval miss candidate"),
        ((None, None, None, None), None, None, "FAIL_NO_RESULT", [], "NO_RETRIEVAL_EXPECTATION_TO_DIAGNOSE", "True retrieval miss candidate"),
    ]
    rows = []
    for k, (row, found, candidates, *_) in enumerate(cases):
        found = None if found is None else [(i, *h[1:]) for i, h in enumerate(found, 1)]
        rows.append((k, *row, found, candidates))
    got = E.evaluated(spark.createDataFrame(rows, PLAN)).orderBy("k").collect()
    want = [(s, [2] if s == "PASS_PAGE" else [2] if "document" in (c[1] or "") and s.startswith("PASS") else r, d, v) for c, _, _, s, r, d, v in cases]
    assert [(r["status"], r["ranks"], r["diagnosis"], r["review"]) for r in got] == want


def test_each_reason_for_the_larger_model(spark):
    doc = lambda **x: tuple(({"id": "i", "title": "t", "source": "s", "country": "DE", "metadata": None} | x).values())
    base = {"question": "How are fees paid?", "talk": False, "sure": 0.9, "documents": [doc()]}
    cases = [
        ({}, []), ({"talk": True}, ["conversation_context"]), ({"sure": 0.7}, ["lower_confidence"]), ({"sure": None}, ["lower_confidence"]), ({"question": "x" * 221}, ["long_question"]), ({"question": "Who? Where？"}, ["multi_part_question"]),
        ({"question": "Is it 5"}, ["explicit_numeric_claim"]), ({"question": "How many € is it"}, ["explicit_numeric_claim"]), ({"documents": [doc(), doc(source="", title="other")]}, ["multiple_documents"]), ({"documents": [doc(), doc(source=" ", title="", id="s")]}, []),
        ({"documents": [doc(), doc(country="at")]}, ["cross_market_evidence"]), ({"documents": [doc(country="de"), doc(country=" ")]}, []), ({"documents": [doc(metadata={"table_row": "true"})]}, ["structured_evidence"]), ({"documents": [doc(metadata={"is_table": "false", "x": "1"})]}, []),
        ({"documents": None, "question": None}, []),
    ]
    rows = [(k, *(base | changed).values()) for k, (changed, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, question string, has_conversation boolean, confidence double, documents array<struct<id:string,title:string,source:string,country:string,metadata:map<string,string>>>")
    got = E.route(df).orderBy("k").collect()
    assert [r["reasons"] for r in got] == [w for _, w in cases]
    assert [r["target"] for r in got] == ["complex" if w else "fast" for _, w in cases]
