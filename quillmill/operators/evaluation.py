"""How retrieval did on a test plan, and which model an answer needs: rules over given columns.

A plan's row has its question, the expected source and page or section, and a test type; what was found is an array of
(rank, title, page, source, excerpt, score), and so are the candidates that it was chosen from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.retrieval import bm25_search
from quillmill.plans.catalogue import register
from quillmill.sources.views import table

#: Test types, and marks of rows whose right result is no document.
RETRIEVAL_TYPES = ("retrieval", "retrieval_test", "retrieval test", "source_retrieval", "source retrieval")
OTHER_TYPES = ("not_in_document", "not in document", "conversation", "conversation_test", "conversation test", "guardrail", "guardrail_test", "guardrail test", "needs_review", "needs review", "unsupported", "out_of_scope", "out of scope")
OTHER_MARKS = (
    "n/a", "refusal", "refus", "out of scope", "off-topic", "hors sujet", "pii", "consent", "session", "clarify", "input validation", "input length", "injection", "xss", "memory check", "role scope", "sentiment", "not in kb", "version scope",
)
FOLLOW_UPS, FRENCH_WORDS, FRENCH_LETTERS = ("turn 1", "turn 2", "tell me more", "that"), ("comment", "quel", "numéro", "clientèle"), "[àâçéèêëîïôùûü]"
#: Below this confidence, above this many characters or sources a question needs the larger model; and what marks a structured document.
LEAST_CONFIDENCE, MOST_CHARS, MOST_SOURCES = 0.75, 220, 1
SECTION = r"\b(?:sec|section)\.?\s*([0-9]+(?:\.[0-9]+)?[a-z]?)"
STRUCTURED = ("is_table", "table_row", "requires_calculation", "conflicting_version")


def _text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def row_kind(expected: Column, test_type: Column) -> Column:
    """RETRIEVAL or NON_RETRIEVAL: by the type that is given, else by marks in the expected source."""
    said = _text(test_type)
    return F.when(said.isin(*RETRIEVAL_TYPES), "RETRIEVAL").when(said.isin(*OTHER_TYPES) | _any_of(_text(expected), OTHER_MARKS), "NON_RETRIEVAL").otherwise("RETRIEVAL")


def expected_pages(raw: Column) -> Column:
    """Page numbers, those within ranges too, as text; the number of a section is no page."""
    raw = F.regexp_replace(F.coalesce(raw, F.lit("")), rf"(?i){SECTION}(?:\s*[-–]\s*[0-9]+(?:\.[0-9]+)?[a-z]?)?", " ")
    number = lambda x, k: F.regexp_extract(x, r"(\d+)\s*[-–]\s*(\d+)", k).cast("int")
    ranges = F.filter(F.regexp_extract_all(raw, F.lit(r"(\d+)\s*[-–]\s*(\d+)"), F.lit(0)), lambda x: number(x, 1) <= number(x, 2))
    single = F.regexp_extract_all(raw, F.lit(r"\d+(?:\.0+)?"), F.lit(0))
    return F.transform(F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(ranges, lambda x: F.sequence(number(x, 1), number(x, 2)))), F.transform(single, lambda x: x.cast("double").cast("int"))))), lambda n: n.cast("string"))


def expected_sections(raw: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(raw, F.lit(""))), F.lit(SECTION), F.lit(1))


def names_document(expected: Column) -> Column:
    e = _text(expected)
    return F.contains(e, F.lit(".pdf")) | F.contains(e, F.lit("document"))


def source_matches(expected: Column, one: Column) -> Column:
    """The expected file's name, or else one of the expectation's words, in title or source."""
    e = _text(expected)
    hay = F.lower(F.concat_ws(" ", one["title"], one["source"]))
    tokens = F.regexp_extract_all(e, F.lit(r"[a-z0-9][a-z0-9._-]{2,}"), F.lit(0))
    return F.when(F.contains(e, F.lit(".pdf")), F.contains(hay, F.element_at(F.split(e, "/"), -1))).otherwise(F.exists(tokens, lambda t: F.contains(hay, t)))


def section_matches(sections: Column, one: Column) -> Column:
    """A section by its number; dots may be dashes, and a letter may follow, in brackets too."""
    hay = F.lower(F.concat_ws(" ", one["title"], one["source"], one["excerpt"]))

    def pattern(s: Column) -> Column:
        base = F.regexp_replace(s, "[a-z]$", "")
        return F.concat(F.lit(r"\b(?:"), F.replace(base, F.lit("."), F.lit("[-.]")), F.lit(r"[a-z]?\b|"), F.replace(base, F.lit("."), F.lit(r"\.")), F.lit(r"\s*\([a-z]\))"))

    return F.exists(sections, lambda s: F.regexp_like(hay, pattern(s)))


def evaluated(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kind``, ``status``, ``ranks`` (of what matched), ``diagnosis`` and ``review`` (a bucket for misses).

    Columns: question, expected_source, expected_page, test_type, found and candidates.
    """
    expected = F.col("expected_source")
    out = rows.withColumn("kind", row_kind(expected, F.col("test_type"))).withColumn("_pages", expected_pages(F.col("expected_page"))).withColumn("_sections", expected_sections(F.col("expected_page")))
    named, pages, sections = names_document(expected), F.size("_pages") > 0, F.size("_sections") > 0
    pick = lambda among, ok: F.transform(F.filter(among, ok), lambda s: s["rank"])
    by_source = lambda among: F.when(named, pick(among, lambda s: source_matches(expected, s))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_source", by_source("found")).withColumn("_page", pick("found", lambda s: F.array_contains("_pages", s["page"]))).withColumn("_section", pick("found", lambda s: section_matches(F.col("_sections"), s)))
    out = out.withColumn("_had_source", F.size(by_source("candidates")) > 0).withColumn("_had_section", F.exists("candidates", lambda s: section_matches(F.col("_sections"), s)))
    some = lambda c: F.size(c) > 0
    status = (
        F.when(F.coalesce(F.size("found"), F.lit(0)) <= 0, "FAIL_NO_RESULT")
        .when(pages & some("_page"), "PASS_PAGE")
        .when(sections & some("_section"), "PASS_SECTION_HINT")
        .when(sections, "FAIL_SECTION_NOT_FOUND")
        .when(some("_source"), F.when(pages, "PASS_DOC_WRONG_PAGE").otherwise("PASS_DOC_ONLY_NEEDS_EXPECTED_PAGE"))
        .when(pages | (F.coalesce(expected, F.lit("")) != ""), "FAIL_WRONG_SOURCE")
        .otherwise("UNSCORABLE_MISSING_EXPECTED_SOURCE")
    )
    out = out.withColumn("status", status)
    ranks = F.when(F.col("status") == "PASS_PAGE", F.col("_page")).when(F.col("status") == "PASS_SECTION_HINT", F.col("_section")).when(F.col("status").startswith("PASS"), F.col("_source"))
    where = lambda had, what: F.when(had, f"EXPECTED_{what}_IN_CANDIDATES_NOT_SELECTED").otherwise(f"EXPECTED_{what}_NOT_IN_CANDIDATES")
    diagnosis = (
        F.when(F.col("status").startswith("PASS"), "FINAL_SELECTION_OK")
        .when(sections, where(F.coalesce("_had_section", F.lit(False)), "SECTION"))
        .when(named, where(F.col("_had_source"), "SOURCE"))
        .otherwise("NO_RETRIEVAL_EXPECTATION_TO_DIAGNOSE")
    )
    out = out.withColumn("ranks", F.coalesce(ranks, F.array().cast("array<int>"))).withColumn("diagnosis", diagnosis)
    q, top = _text(F.col("question")), F.get("found", F.lit(0))
    contact = F.contains(_text(expected), F.lit("customer care")) & F.contains(F.lower(F.concat_ws(" ", top["title"], top["excerpt"])), F.lit("contact"))
    review = (
        F.when(F.col("status").startswith("PASS"), None)
        .when(F.col("diagnosis").endswith("_NOT_SELECTED"), "Final selector/reranker miss")
        .when(F.col("diagnosis").endswith("_NOT_IN_CANDIDATES"), "Candidate retrieval miss")
        .when(_any_of(q, FOLLOW_UPS), "Not a pure retrieval test")
        .when(q.rlike(FRENCH_LETTERS) | _any_of(q, FRENCH_WORDS), "Language routing or translation needed")
        .when(contact | (F.col("status") == "FAIL_SECTION_NOT_FOUND") & F.coalesce(top["score"] >= 0.7, F.lit(False)), "Expected source needs confirmation")
        .otherwise("True retrieval miss candidate")
    )
    return out.withColumn("review", review).drop("_pages", "_sections", "_source", "_page", "_section", "_had_source", "_had_section")


def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan from the questions: what is expected comes from the document of the question's number, what was found from the search."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    expected = d.select(
        F.col("doc_id").alias("item_id"),
        F.concat("source", F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "de", " document").otherwise("")).alias("expected_source"),
        F.when(F.col("n_chars") > 2500, "pages 2-4, 9").when(F.col("lang") == "de", "Section 2.1").otherwise("").alias("expected_page"),
        F.when(F.col("n_chars") < 300, "guardrail").alias("test_type"),
    )
    hit = F.struct(F.col("rank").cast("int").alias("rank"), F.concat("source", F.lit(".pdf")).alias("title"), F.pmod("n_chars", F.lit(10)).cast("string").alias("page"), "source", F.substring("text", 1, 500).alias("excerpt"), "score")
    found = bm25_search(spark, sf_dir).join(d, "doc_id").groupBy("item_id").agg(F.array_sort(F.collect_list(hit)).alias("candidates"))  # ten at most
    plan = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question")).join(expected, "item_id").join(found, "item_id", "left")
    none = F.array().cast(plan.schema["candidates"].dataType)
    return plan.withColumn("candidates", F.coalesce("candidates", none)).withColumn("found", F.slice("candidates", 1, 5))


def _review_sql() -> str:
    from quillmill.plans import catalogue

    return f"""WITH b AS ({catalogue._SQL['bm25_search']}), x AS (SELECT q.item_id, q.text AS question, e.lang, e.source || CASE e.lang WHEN 'en' THEN '.pdf' WHEN 'de' THEN ' document' ELSE '' END AS expected, e.source, e.n_chars > 2500 AS pages, e.n_chars <= 2500 AND e.lang = 'de' AS sections, e.n_chars < 300 AS guard
  FROM benchmark q JOIN documents e ON q.item_id = e.doc_id),
f AS (SELECT x.item_id, count(*) FILTER (b.rank <= 5) AS n, count(*) FILTER (b.rank <= 5 AND d.n_chars % 10 IN (2, 3, 4, 9)) AS page, count(*) FILTER (b.rank <= 5 AND contains(lower(d.source || '.pdf ' || d.source), lower(x.source) || CASE WHEN lang = 'en' THEN '.pdf' ELSE '' END)) AS source,
  count(*) FILTER (contains(lower(d.source || '.pdf ' || d.source), lower(x.source) || CASE WHEN lang = 'en' THEN '.pdf' ELSE '' END)) AS had_source, count(*) FILTER (b.rank <= 5 AND sec) AS section, count(*) FILTER (sec) AS had_section
  FROM x LEFT JOIN b USING (item_id) LEFT JOIN (SELECT doc_id, source, n_chars, regexp_matches(lower(substr(text, 1, 500)), '\\b(?:2[-.]1[a-z]?\\b|2\\.1\\s*\\([a-z]\\))') AS sec FROM documents) d USING (doc_id) GROUP BY x.item_id),
s AS (SELECT x.*, f.*, CASE WHEN n = 0 THEN 'FAIL_NO_RESULT' WHEN pages AND page > 0 THEN 'PASS_PAGE' WHEN sections AND section > 0 THEN 'PASS_SECTION_HINT' WHEN sections THEN 'FAIL_SECTION_NOT_FOUND'
  WHEN lang IN ('en', 'de') AND f.source > 0 THEN CASE WHEN pages THEN 'PASS_DOC_WRONG_PAGE' ELSE 'PASS_DOC_ONLY_NEEDS_EXPECTED_PAGE' END ELSE 'FAIL_WRONG_SOURCE' END AS status FROM x JOIN f ON x.item_id = f.item_id),
g AS (SELECT *, CASE WHEN starts_with(status, 'PASS') THEN 'FINAL_SELECTION_OK' WHEN sections THEN CASE WHEN had_section > 0 THEN 'EXPECTED_SECTION_IN_CANDIDATES_NOT_SELECTED' ELSE 'EXPECTED_SECTION_NOT_IN_CANDIDATES' END
  WHEN lang IN ('en', 'de') THEN CASE WHEN had_source > 0 THEN 'EXPECTED_SOURCE_IN_CANDIDATES_NOT_SELECTED' ELSE 'EXPECTED_SOURCE_NOT_IN_CANDIDATES' END ELSE 'NO_RETRIEVAL_EXPECTATION_TO_DIAGNOSE' END AS diagnosis FROM s)
SELECT item_id, CASE WHEN guard THEN 'NON_RETRIEVAL' ELSE 'RETRIEVAL' END AS kind, status, diagnosis, CASE WHEN starts_with(status, 'PASS') THEN NULL WHEN ends_with(diagnosis, '_NOT_SELECTED') THEN 'Final selector/reranker miss' WHEN ends_with(diagnosis, '_NOT_IN_CANDIDATES') THEN 'Candidate retrieval miss'
  WHEN contains(lower(question), 'that') THEN 'Not a pure retrieval test' WHEN regexp_matches(lower(question), '{FRENCH_LETTERS}|comment|quel|numéro|clientèle') THEN 'Language routing or translation needed' ELSE 'True retrieval miss candidate' END AS review FROM g"""


@register("retrieval_review", _review_sql())
def retrieval_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's row of the plan: did the search pass, why not, and what to look at first."""
    return evaluated(plan_rows(spark, sf_dir)).select("item_id", "kind", "status", "diagnosis", "review")


def route(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``reasons`` for the larger model and the ``target``; with none of eight reasons the fast one does.

    Columns: question, has_conversation, confidence, and documents as an array of (id, title, source, country, metadata).
    """
    q = F.trim(F.coalesce("question", F.lit("")))
    filled = lambda *cs: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))
    different = lambda of: F.size(F.array_distinct(F.filter(F.transform("documents", of), lambda x: x.isNotNull())))
    on = lambda m: F.exists(F.array(*map(F.lit, STRUCTURED)), lambda k: ~F.lower(F.coalesce(m[k], F.lit(""))).isin("", "false", "0"))
    reasons = (
        (F.coalesce("has_conversation", F.lit(False)), "conversation_context"),
        (F.coalesce("confidence", F.lit(0.0)) < LEAST_CONFIDENCE, "lower_confidence"),
        (F.length(q) > MOST_CHARS, "long_question"),
        (F.length(F.regexp_replace(q, "[^?؟？]", "")) > 1, "multi_part_question"),
        (q.rlike(r"[\p{Nd}\p{Sc}%‰]"), "explicit_numeric_claim"),
        (different(lambda d: filled(d["source"], d["title"], d["id"])) > MOST_SOURCES, "multiple_documents"),
        (different(lambda d: F.upper(filled(d["country"]))) > 1, "cross_market_evidence"),
        (F.exists("documents", lambda d: on(d["metadata"])), "structured_evidence"),
    )
    found = F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), name) for ok, name in reasons)))
    return rows.withColumn("reasons", found).withColumn("target", F.when(F.size("reasons") > 0, "complex").otherwise("fast"))


@register(
    "model_routes",
    rf"""WITH c AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS q, turn > 0 AS more FROM conversations WHERE role = 'user'), l AS (SELECT l_orderkey, count(DISTINCT flag) AS modes, bool_or(l_tax > 0.07) AS taxed, avg(l_discount) AS mean FROM (SELECT l_orderkey, l_returnflag AS flag, l_tax, l_discount FROM lineitem) x GROUP BY l_orderkey),
p AS (SELECT l_orderkey, count(DISTINCT n_name) AS nations FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_orderkey)
SELECT conv_id, turn, list_filter([CASE WHEN more THEN 'conversation_context' END, CASE WHEN coalesce(10 * round(mean, 4), 0) < 0.75 THEN 'lower_confidence' END, CASE WHEN length(q) > 220 THEN 'long_question' END, CASE WHEN length(regexp_replace(q, '[^?؟？]', '', 'g')) > 1 THEN 'multi_part_question' END,
  CASE WHEN regexp_matches(q, '[\p{{Nd}}\p{{Sc}}%‰]') THEN 'explicit_numeric_claim' END, CASE WHEN modes > 1 THEN 'multiple_documents' END, CASE WHEN nations > 1 THEN 'cross_market_evidence' END, CASE WHEN taxed THEN 'structured_evidence' END], lambda x: x IS NOT NULL) AS reasons FROM c LEFT JOIN l ON conv_id = l.l_orderkey LEFT JOIN p ON conv_id = p.l_orderkey""",
)
def model_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of each question; the lines of the order with the conversation's number are its evidence."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    li = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    one = F.struct(F.col("l_partkey").cast("string").alias("id"), F.lit("").alias("title"), F.col("l_returnflag").alias("source"), F.col("n_name").alias("country"), F.create_map(F.lit("is_table"), (F.col("l_tax") > 0.07).cast("string")).alias("metadata"))
    evidence = li.groupBy("l_orderkey").agg(F.collect_list(one).alias("documents"), (10 * F.round(F.avg("l_discount"), 4)).alias("confidence"))
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), (F.col("turn") > 0).alias("has_conversation"))
    return route(c.join(evidence, F.col("conv_id") == F.col("l_orderkey"), "left")).select("conv_id", "turn", "reasons")
