"""Evidence contracts, validators, excerpts and relevance on cases and against brute force."""

import json
import re

from pyspark.sql import functions as F

from quillmill.operators import answers

GOOD = {
    "status": "Approved ", "answer": " Yes. ", "evidence_ids": ["a", " b", "a", "", None, 7],
    "claims": [{"text": "one", "evidence_ids": ["a"]}, {"text": "two", "evidence_ids": ["b", 7]}],
    "coverage": {"complete": True, "omitted_material_facts": ["", None]},
}


def test_all_reasons_of_the_contract(spark):
    cases = [
        ("", GOOD), ("answer_not_approved", GOOD | {"status": "draft"}), ("answer_not_approved", GOOD | {"answer": " "}), ("answer_not_approved", {}), ("missing_evidence_ids", GOOD | {"evidence_ids": "a"}),
        ("missing_evidence_ids", GOOD | {"evidence_ids": [" "]}), ("unknown_evidence_id", GOOD | {"evidence_ids": ["a", "z"]}), ("missing_claims", GOOD | {"claims": []}), ("missing_claims", GOOD | {"claims": {"text": "x"}}),
        ("invalid_claim", GOOD | {"claims": [GOOD["claims"][0], "two", {"text": ""}]}), ("claim_missing_support", GOOD | {"claims": [{"text": " ", "evidence_ids": ["a"]}, "x"]}), ("claim_missing_support", GOOD | {"claims": [{"text": "x"}]}),
        ("claim_uses_unlisted_evidence", GOOD | {"claims": [{"text": "x", "evidence_ids": ["c"]}]}), ("missing_coverage_check", GOOD | {"coverage": [1]}), ("incomplete_answer", GOOD | {"coverage": {"complete": "true"}}),
        ("incomplete_answer", GOOD | {"coverage": {}}), ("invalid_coverage_check", GOOD | {"coverage": {"complete": True}}), ("invalid_coverage_check", GOOD | {"coverage": {"complete": True, "omitted_material_facts": "none"}}),
        ("incomplete_answer", GOOD | {"coverage": {"complete": True, "omitted_material_facts": ["", "a fee"]}}),
    ]
    texts = [(k, want, json.dumps(body)) for k, (want, body) in enumerate(cases)]
    texts += [(90, "invalid_json", None), (91, "invalid_json", "no"), (92, "invalid_json", "[1]"), (93, "invalid_json", "}{"), (94, "", f"Sure: {json.dumps(GOOD)} Done."), (95, "invalid_json", "{'status': 1"), (96, "invalid_json", "")]
    rows = spark.createDataFrame([(*t, ["a", "b", "c", "7"]) for t in texts], "k int, want string, reply string, allowed array<string>")
    got = answers.judged(rows, "reply", "allowed").orderBy("k").collect()
    assert [(r["k"], r["reason"]) for r in got] == [(r["k"], r["want"]) for r in got] and len(got) == len(texts)
    assert got[0]["answer"] == "Yes." and got[0]["evidence_ids"] == ["a", "b", "7"] and got[1]["answer"] == "" and got[1]["evidence_ids"] == []
    assert {w for _, w, _ in texts} == {"", "answer_not_approved", "missing_evidence_ids", "unknown_evidence_id", "missing_claims", "invalid_claim", "claim_missing_support", "claim_uses_unlisted_evidence", "missing_coverage_check", "incomplete_answer", "invalid_coverage_check", "invalid_json"}


def response(**changed):
    row = {"answer": "Members get 30 percent off.", "language": "en-GB", "confidence": 0.5, "documents": 1, "citations": [{"title": "t", "uri": "u", "source": None}], "metadata": {"language": "EN_us"}, "model_metadata": None, "evidence": "All members get 30 percent off the list."}
    return tuple((row | changed).values())


def test_each_validator(spark):
    cases = [
        ([], "INFO", {}), (["ANSWER_EMPTY", "INCOMPLETE_OUTPUT"], "CRITICAL", {"answer": " \n"}), (["UNRESOLVED_OUTPUT_PLACEHOLDER"], "CRITICAL", {"answer": "Call [phone: main] today."}),
        (["INCOMPLETE_OUTPUT"], "CRITICAL", {"answer": "This is the"}), (["INCOMPLETE_OUTPUT"], "CRITICAL", {"answer": "This (is."}), ([], "INFO", {"answer": "Das ist a", "language": "de", "metadata": {"language": "de"}}),
        (["CONFIDENCE_OUT_OF_RANGE"], "ERROR", {"confidence": 1.2}), ([], "INFO", {"confidence": None}), (["CITATIONS_MISSING"], "WARNING", {"citations": []}), ([], "INFO", {"citations": None, "documents": 0}),
        (["CITATIONS_INCOMPLETE"], "WARNING", {"citations": [{"title": "t", "uri": "u", "source": None}, {"title": "t", "uri": "", "source": None}]}), (["LANGUAGE_MISMATCH"], "WARNING", {"metadata": {"detected_language": "fr"}}),
        (["LANGUAGE_MISMATCH"], "WARNING", {"metadata": {"x": "y"}, "model_metadata": {"response_language": "de-AT"}}), (["METADATA_MISSING"], "ERROR", {"metadata": None}), (["ANSWER_TOO_LONG"], "ERROR", {"answer": "x" * 10_001}),
        (["NUMERIC_CLAIM_UNSUPPORTED"], "CRITICAL", {"answer": "Members get 40 percent off."}), ([], "INFO", {"answer": "Members get 40 percent off.", "evidence": None}),
    ]
    kind = "answer string, language string, confidence double, documents int, citations array<struct<title:string,uri:string,source:string>>, metadata map<string,string>, model_metadata map<string,string>, evidence string"
    rows = spark.createDataFrame([(k, *response(**changed)) for k, (_, _, changed) in enumerate(cases)], "k int, " + kind)
    got = answers.validated(rows).orderBy("k").collect()
    assert [([i["code"] for i in r["issues"]], r["highest"]) for r in got] == [(codes, highest) for codes, highest, _ in cases]
    assert [r["valid"] for r in got] == [highest != "CRITICAL" for _, highest, _ in cases]


def excerpt_by_hand(question, text, size=320):
    tokens = lambda x: {w for w in re.findall(r"[^\W_]+", x.lower()) if len(w) > 3 and w not in answers.ANSWER_STOP_WORDS}
    figures = lambda x: set(re.findall(answers.NUMBER, x))
    names = [x.lower() for x in re.findall(answers.NAMED, question)]

    def score(window):
        a, b = tokens(question), tokens(window)
        if not a or not b:
            return 0.0
        s = len(a & b) / len(a) + (0.55 * len(figures(question) & figures(window)) / len(figures(question)) if figures(question) else 0)
        return round(s + (0.25 * sum(n in window.lower() for n in names) / len(names) if names else 0), 6)

    parts = [text[i : i + size] for i in range(0, max(len(text), 1), size // 2)]
    best = max(parts, key=score)
    return (score(best), (best if score(best) > 0 else text[:size]).strip())


def test_excerpts_equal_brute_force(spark):
    filler = "Nothing of note stands in these lines of ours. " * 9
    pairs = [("The Silver Coast discount is 25 for members", filler + "At Silver Coast the members have a discount of 25. " + filler), ("none", filler), ("", filler), ("Members pay 3.5", ""), ("discount members", "members " * 200 + "discount members " + "x " * 300)]
    df = spark.createDataFrame(pairs, "question string, text string").withColumn("answer", answers.answer_parts(F.col("question")))
    got = [(r["b"]["score"], r["b"]["excerpt"]) for r in df.select(answers.best_excerpt("answer", "text").alias("b")).collect()]
    assert got == [excerpt_by_hand(*p) for p in pairs]


def test_object_is_parsed_without_its_schema(spark):
    texts = ['{"a": 1}', ' \t\n{"a": [1, {"b": 2}]}\r\n', 'Answer: {"a": 1} so', '[{"a": 1}]', "[1]", '"{}"', "{", "}{", "", None, '{"a": 1} x', "3"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(answers.parsed_object(F.col("t")).cast("string").alias("v"))
    assert "schema_of_variant" not in df._jdf.queryExecution().toString() and "regexp" not in df._jdf.queryExecution().toString()
    assert [r["v"] for r in df.collect()] == ['{"a":1}', '{"a":[1,{"b":2}]}', '{"a":1}', '{"a":1}', None, "{}", None, None, None, None, '{"a":1}', None]
