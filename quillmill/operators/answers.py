"""What may be answered: a contract between an answer and its evidence, eight validators, and excerpts that support an answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillmill.functions.chunking import numeric_claims, supported
from quillmill.functions.text import unbalanced
from quillmill.operators.retrieval import bm25_search
from quillmill.plans.catalogue import register
from quillmill.sources.views import table

# The evidence contract: JSON of an answer, its evidence, its claims and what it leaves out.


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN ...; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _ids(v: Column) -> Column:
    """Different identifiers of a JSON list, in order, without blank ones; anything else has none."""
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.trim(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))))
    return F.coalesce(F.array_distinct(F.filter(items, lambda x: x != "")), F.array().cast("array<string>"))


def parsed_object(text: Column) -> Column:
    """The JSON object in a text, as a variant; a few words before and after it do no harm.

    JSON that begins with a brace is an object, so its schema, which takes all that it holds, isn't asked for.
    """
    s = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    first, last = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
    framed = F.when(s.startswith("{"), s).when((first > 0) & F.contains(s, F.lit("}")) & (last > first), F.substring(s, first, last - first + 1))
    return F.try_parse_json(framed)


def judged(rows: DataFrame, text: str, allowed: str) -> DataFrame:
    """``rows`` with the ``reason``, ``answer`` and ``evidence_ids`` of a JSON answer in the column ``text``.

    The first rule that is broken names the reason, and an accepted answer has none.
    ``allowed`` is the column with the ids of the evidence that was given.  Each part is a
    column of its own, so that a text is parsed once.
    """
    word = lambda path: F.trim(F.coalesce(_at(F.col("_v"), path, "string"), F.lit("")))
    at = F.col("_v")
    parts = rows.withColumn("_v", parsed_object(F.col(text)))
    parts = parts.withColumn("_ids", _ids(_at(at, "$.evidence_ids"))).withColumn("_claims", _at(at, "$.claims", "array<variant>"))
    parts = parts.withColumn("_said", F.transform("_claims", lambda c: F.struct(_kind(c).alias("kind"), F.trim(F.coalesce(_at(c, "$.text", "string"), F.lit(""))).alias("text"), _ids(_at(c, "$.evidence_ids")).alias("ids"))))

    def wrong(claim: Column) -> Column:
        return (
            F.when(F.coalesce(claim["kind"], F.lit("")) != "OBJECT", "invalid_claim")
            .when((claim["text"] == "") | (F.size(claim["ids"]) == 0), "claim_missing_support")
            .when(F.size(F.array_except(claim["ids"], F.col("_ids"))) > 0, "claim_uses_unlisted_evidence")
        )

    parts = parts.withColumn("_wrong", F.get(F.array_compact(F.transform("_said", wrong)), F.lit(0)))
    complete, omitted = _at(at, "$.coverage.complete"), _at(at, "$.coverage.omitted_material_facts")
    reason = (
        F.when(at.isNull(), "invalid_json")
        .when((F.lower(word("$.status")) != "approved") | (word("$.answer") == ""), "answer_not_approved")
        .when(F.size("_ids") == 0, "missing_evidence_ids")
        .when(F.size(F.array_except("_ids", allowed)) > 0, "unknown_evidence_id")
        .when(F.coalesce(F.size("_claims"), F.lit(0)) <= 0, "missing_claims")
        .when(F.col("_wrong").isNotNull(), F.col("_wrong"))
        .when(F.coalesce(_kind(_at(at, "$.coverage")), F.lit("")) != "OBJECT", "missing_coverage_check")
        .when(~F.coalesce((_kind(complete) == "BOOLEAN") & F.try_variant_get(complete, "$", "boolean"), F.lit(False)), "incomplete_answer")
        .when(F.coalesce(_kind(omitted), F.lit("")) != "ARRAY", "invalid_coverage_check")
        .when(F.size(_ids(omitted)) > 0, "incomplete_answer")
        .otherwise("")
    )
    parts = parts.withColumn("_reason", reason)
    good = F.col("_reason") == ""
    none = F.array().cast("array<string>")
    return parts.select(*rows.columns, F.col("_reason").alias("reason"), F.when(good, word("$.answer")).otherwise("").alias("answer"), F.when(good, F.col("_ids")).otherwise(none).alias("evidence_ids"))


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer in JSON for each order: its lines are claims, their parts the evidence, parts sold at a small discount what is allowed."""
    parts = lambda keep: F.array_distinct(F.transform(F.filter("lines", keep), lambda x: x["part"]))
    line = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("part"), "l_discount", "l_quantity", "l_tax")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    o = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    claim = lambda x: F.struct(F.concat(F.lit("part "), x["part"]).alias("text"), F.when(x["l_quantity"] >= 2, F.array(x["part"])).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))
    left_out = F.transform(F.filter("lines", lambda x: x["l_tax"] > 0.075), lambda x: F.concat(F.lit("tax of "), x["part"]))
    coverage = F.struct((F.col("o_totalprice") > 2000).alias("complete"), left_out.alias("omitted_material_facts"))
    body = F.struct(F.when(F.col("o_orderstatus") == "P", "draft").otherwise("approved").alias("status"), F.col("o_orderpriority").alias("answer"), parts(lambda x: x["l_linenumber"] <= 5).alias("evidence_ids"), F.transform("lines", claim).alias("claims"), coverage.alias("coverage"))
    return o.select("o_orderkey", F.concat(F.lit("Answer: "), F.to_json(body)).alias("reply"), parts(lambda x: x["l_discount"] < 0.095).alias("allowed"))


@register(
    "claim_contract",
    """WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber <= 5) AS listed, bool_or(l_quantity < 2) AS bare, bool_or(l_tax > 0.075) AS omitted,
  list_distinct(list(l_partkey) FILTER (l_linenumber <= 5)) AS ids, list_distinct(list(l_partkey) FILTER (l_discount < 0.095)) AS allowed, list({'n': l_linenumber, 'p': l_partkey, 'q': l_quantity} ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS claims FROM lineitem GROUP BY l_orderkey),
w AS (SELECT *, list_filter(list_transform(claims, lambda x: CASE WHEN x.q < 2 THEN 'claim_missing_support' WHEN NOT list_contains(ids, x.p) THEN 'claim_uses_unlisted_evidence' ELSE '' END), lambda x: x <> '') AS wrong FROM l)
SELECT reason, count(*) AS answers FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'answer_not_approved' WHEN coalesce(listed, 0) = 0 THEN 'missing_evidence_ids'
  WHEN len(list_filter(ids, lambda x: NOT list_contains(coalesce(allowed, []), x))) > 0 THEN 'unknown_evidence_id' WHEN len(wrong) > 0 THEN wrong[1] WHEN o_totalprice <= 2000 OR omitted THEN 'incomplete_answer' ELSE '' END AS reason
  FROM orders LEFT JOIN w ON o_orderkey = l_orderkey) x GROUP BY reason""",
)
def claim_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many answers of each order's lines are accepted, and why the others aren't."""
    return judged(order_answers(spark, sf_dir), "reply", "allowed").groupBy("reason").agg(F.count("*").alias("answers"))


# Eight validators of a response; each adds issues, and errors or worse make it invalid.

#: Placeholders that mustn't be left, words that no English answer ends on, the longest answer, and the keys that name a language.
PLACEHOLDER = r"(?i)\*{4,}|(?:\[|\{|<)(?:ADDRESS|EMAIL|NAME|PHONE|PII|URL|WEBSITE|CONTACT|TBD)(?::[^\]\}>]*)?(?:\]|\}|>)"
OPEN_END = r"(?i)(?:^|[^\p{L}\p{N}_])(?:a|an|the)\s*[.!?]?\s*$"
LONGEST = 10_000
LANGUAGE_KEYS = ("language", "response_language", "detected_language")
SEVERITY = {"INFO": 0, "WARNING": 1, "ERROR": 2, "CRITICAL": 3}


@F.pandas_udf(BooleanType())
def ungrounded(answers: pd.Series, evidence: pd.Series) -> pd.Series:
    """Does an answer hold a number that its evidence doesn't support? Without evidence nothing is said."""

    def one(a: str | None, e: str | None) -> bool:
        return bool(a and e) and any(not supported(c, a, e) for c in numeric_claims(a))

    return pd.Series([one(a, e) for a, e in zip(answers, evidence, strict=True)], dtype=bool)


def short_language(value: Column) -> Column:
    return F.split_part(F.translate(F.lower(F.trim(value)), "_", "-"), F.lit("-"), F.lit(1))


def validated(rows: DataFrame, grounded: Column | None = None) -> DataFrame:
    """``rows`` with ``issues`` (code, severity, field), the ``highest`` severity and ``valid`` (nothing critical).

    Columns: answer, language, confidence, documents (their number), citations (array of
    title, uri, source), metadata and model_metadata (maps), evidence (one text).  ``grounded``
    replaces the check of numbers.
    """
    answer, text = F.col("answer"), F.regexp_replace(F.coalesce("answer", F.lit("")), r"^\s+|\s+$", "")
    said = F.coalesce(*(F.nullif(F.trim(F.col(m)[k]), F.lit("")) for m in ("metadata", "model_metadata") for k in LANGUAGE_KEYS))
    expected, actual = short_language(F.coalesce("language", F.lit(""))), short_language(F.coalesce(said, F.lit("")))
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    thin = F.exists("citations", lambda c: ~(filled(c["title"]) & (filled(c["uri"]) | filled(c["source"]))))
    none_cited = F.coalesce(F.size("citations"), F.lit(0)) <= 0
    english = short_language(F.coalesce(F.nullif("language", F.lit("")), F.lit("en"))) == "en"
    broken = (text == "") | unbalanced(text) | (english & text.rlike(OPEN_END))
    loose = ungrounded(answer, F.col("evidence")) if grounded is None else ~grounded
    rules = (
        (text == "", "ANSWER_EMPTY", "CRITICAL", "answer"),
        (text.rlike(PLACEHOLDER), "UNRESOLVED_OUTPUT_PLACEHOLDER", "CRITICAL", "answer"),
        (broken, "INCOMPLETE_OUTPUT", "CRITICAL", "answer"),
        ((F.col("confidence") < 0) | (F.col("confidence") > 1), "CONFIDENCE_OUT_OF_RANGE", "ERROR", "confidence"),
        ((F.col("documents") > 0) & none_cited, "CITATIONS_MISSING", "WARNING", "citations"),
        ((F.col("documents") > 0) & ~none_cited & thin, "CITATIONS_INCOMPLETE", "WARNING", "citations"),
        ((expected != "") & (actual != "") & (expected != actual), "LANGUAGE_MISMATCH", "WARNING", "language"),
        (F.col("metadata").isNull(), "METADATA_MISSING", "ERROR", "metadata"),
        (F.length(F.coalesce(answer, F.lit(""))) > LONGEST, "ANSWER_TOO_LONG", "ERROR", "answer"),
        (loose, "NUMERIC_CLAIM_UNSUPPORTED", "CRITICAL", "answer"),
    )
    issue = lambda code, severity, field: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field"))
    issues = F.array_compact(F.array(*(F.when(F.coalesce(wrong, F.lit(False)), issue(*names)) for wrong, *names in rules)))
    out = rows.withColumn("issues", issues)
    weight = F.array_max(F.transform("issues", lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in SEVERITY.items() for v in kv)), x["severity"])))
    return out.withColumn("highest", F.element_at(F.array(*map(F.lit, SEVERITY)), F.coalesce(weight, F.lit(0)) + 1)).withColumn("valid", F.coalesce(weight, F.lit(0)) < SEVERITY["CRITICAL"])


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What assistants say, as responses: the turn before is the evidence, and a document of the conversation's number names language and source."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select(F.col("conv_id").alias("q_conv"), (F.col("turn") + 1).alias("q_turn"), F.col("text").alias("evidence"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), "source", F.col("n_chars").alias("size"))
    r = c.filter("role = 'assistant'").join(asked, (F.col("conv_id") == F.col("q_conv")) & (F.col("turn") == F.col("q_turn")), "left").join(d, F.col("conv_id") == F.col("doc_id"), "left")
    cited = F.when(F.col("size") > 300, F.array(F.struct(F.when(F.col("size") > 600, F.col("language")).alias("title"), F.lit("").alias("uri"), F.col("source").alias("source"))))
    said = F.when(F.col("size").isNotNull(), F.create_map(F.lit("response_language"), F.concat(F.when(F.col("size") > 4000, "en").otherwise(F.col("language")), F.lit("_XX"))))
    return r.select(
        "conv_id", "turn", F.col("text").alias("answer"), "language", (F.col("size") / 10_000).alias("confidence"), F.when(F.col("size") > 0, 1).otherwise(0).alias("documents"), cited.alias("citations"),
        said.alias("metadata"), F.lit(None).cast("map<string,string>").alias("model_metadata"), "evidence",
    )


@register(
    "response_validators",
    rf"""WITH r AS (SELECT c.conv_id, c.turn, regexp_replace(coalesce(c.text, ''), '^\s+|\s+$', '', 'g') AS t, coalesce(c.text, '') AS whole, d.lang, d.source, d.n_chars AS size FROM conversations c LEFT JOIN documents d ON c.conv_id = d.doc_id WHERE c.role = 'assistant'),
i AS (SELECT conv_id, turn, unnest(list_filter([CASE WHEN t = '' THEN 'ANSWER_EMPTY' END, CASE WHEN regexp_matches(t, '{PLACEHOLDER}') THEN 'UNRESOLVED_OUTPUT_PLACEHOLDER' END,
  CASE WHEN t = '' OR length(t) - length(replace(t, '(', '')) <> length(t) - length(replace(t, ')', '')) OR length(t) - length(replace(t, '[', '')) <> length(t) - length(replace(t, ']', ''))
    OR (coalesce(lang, 'en') = 'en' AND regexp_matches(t, '{OPEN_END}')) THEN 'INCOMPLETE_OUTPUT' END,
  CASE WHEN size / 10000.0::DOUBLE > 1 THEN 'CONFIDENCE_OUT_OF_RANGE' END, CASE WHEN size > 0 AND size <= 300 THEN 'CITATIONS_MISSING' END, CASE WHEN size > 300 AND (size <= 600 OR coalesce(lang, '') = '' OR coalesce(source, '') = '') THEN 'CITATIONS_INCOMPLETE' END,
  CASE WHEN size > 4000 AND lang <> 'en' THEN 'LANGUAGE_MISMATCH' END, CASE WHEN size IS NULL OR lang IS NULL AND size <= 4000 THEN 'METADATA_MISSING' END, CASE WHEN length(whole) > 10000 THEN 'ANSWER_TOO_LONG' END], lambda x: x IS NOT NULL)) AS code FROM r)
SELECT code, count(*) AS n FROM i GROUP BY code""",
)
def response_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each issue is found in the assistants' replies; SQL covers all but the check of numbers, which a test holds against cases."""
    found = validated(replies(spark, sf_dir), grounded=F.lit(True)).select(F.explode("issues.code").alias("code"))
    return found.groupBy("code").agg(F.count("*").alias("n"))


@register("ungrounded_replies")
def ungrounded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All validators over all replies, numbers checked against the turn before."""
    return validated(replies(spark, sf_dir)).select("conv_id", "turn", F.col("issues.code").alias("codes"), "highest", "valid")


# Excerpts and relevance from overlapping windows of a text.

#: Words that carry nothing in an answer.
ANSWER_STOP_WORDS = "about also and answer are can does for from have into need that the this with you your".split()
NAMED = r"(?:[A-Z][a-z]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-z]+|[A-Z]{2,}))+"
NUMBER = r"\d+(?:\.\d+)?"
LETTERS = r"[\p{L}\p{N}]+"
EXCERPT, REACH = 320, 420


def windows(text: Column, size: int) -> Column:
    """Windows of so many characters, each half over the one before."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size // 2))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(text, i, F.lit(size)).alias("text")))


def meaning(text: Column, least: int, stop: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop)))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def shared(a: Column, b: Column) -> Column:
    """The part of ``a`` that ``b`` has; 0 where ``a`` is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def support(words: Column, figures: Column, names: Column, text: Column) -> Column:
    """How well a text supports an answer of these words, figures and names."""
    there = meaning(text, 4, ANSWER_STOP_WORDS)
    named = F.when(F.size(names) > 0, F.size(F.filter(names, lambda n: F.contains(F.lower(text), n))) / F.size(names)).otherwise(0.0)
    score = shared(words, there) + 0.55 * shared(figures, numbers(text)) + 0.25 * named
    return F.when((F.size(words) > 0) & (F.size(there) > 0), F.round(score, 6)).otherwise(0.0)


def best_excerpt(answer: str, text: str, size: int = EXCERPT) -> Column:
    """(start, score, excerpt) of the first window with the most support; the beginning, if none has any.

    Both are columns: ``answer_parts`` gives ``answer`` its words, figures and names once a row.
    """
    scored = F.transform(windows(F.col(text), size), lambda w: F.struct(support(F.col(f"{answer}.words"), F.col(f"{answer}.figures"), F.col(f"{answer}.names"), w["text"]).alias("score"), (-w["start"]).alias("at"), w["text"].alias("text")))
    best = F.array_max(scored)
    kept = F.when(best["score"] > 0, best["text"]).otherwise(F.substring(F.col(text), 1, size))
    return F.struct(F.when(best["score"] > 0, -best["at"]).otherwise(1).alias("start"), best["score"].alias("score"), F.regexp_replace(kept, r"^\s+|\s+$", "").alias("excerpt"))


def answer_parts(text: Column) -> Column:
    names = F.transform(F.regexp_extract_all(text, F.lit(NAMED), F.lit(0)), lambda x: F.lower(x))
    return F.struct(meaning(text, 4, ANSWER_STOP_WORDS).alias("words"), numbers(text).alias("figures"), names.alias("names"))


def cited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with the texts that are found for it."""
    found = bm25_search(spark, sf_dir).select("item_id", "doc_id", F.col("score").alias("found"))
    q = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("question"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return found.join(q, "item_id").join(d, "doc_id")


_STOP = ", ".join(f"'{w}'" for w in ANSWER_STOP_WORDS)


def _sql_meaning(text: str, least: int) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '{LETTERS}'), lambda w: length(w) >= {least} AND w NOT IN ({_STOP})))"


def _sql_shared(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a})::DOUBLE ELSE 0.0 END"


def _pairs_sql() -> str:
    from quillmill.plans import catalogue

    return f"""f AS ({catalogue._SQL['bm25_search']}), p AS (SELECT f.item_id, f.doc_id, f.score AS found, coalesce(b.text, '') AS question, coalesce(d.text, '') AS text FROM f JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))"""


@register(
    "best_excerpts",
    rf"""WITH {_pairs_sql()}, a AS (SELECT item_id, doc_id, text, {_sql_meaning('question', 4)} AS words, list_distinct(regexp_extract_all(question, '{NUMBER}')) AS figures, list_transform(regexp_extract_all(question, '{NAMED}'), lambda x: lower(x)) AS names FROM p),
w AS (SELECT *, substr(text, start, {EXCERPT}) AS part FROM (SELECT *, unnest(range(1, greatest(length(text), 1) + 1, {EXCERPT // 2})) AS start FROM a) x), m AS (SELECT *, {_sql_meaning('part', 4)} AS there FROM w),
s AS (SELECT item_id, doc_id, text, start, part, CASE WHEN len(words) > 0 AND len(there) > 0 THEN round({_sql_shared('words', 'there')} + 0.55::DOUBLE * {_sql_shared('figures', f"list_distinct(regexp_extract_all(part, '{NUMBER}'))")}
  + 0.25::DOUBLE * CASE WHEN len(names) > 0 THEN len(list_filter(names, lambda n: contains(lower(part), n))) / len(names)::DOUBLE ELSE 0.0 END, 6) ELSE 0.0 END AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, start) AS i FROM s)
SELECT item_id, doc_id, CAST(CASE WHEN score > 0 THEN start ELSE 1 END AS INTEGER) AS start, score, regexp_replace(CASE WHEN score > 0 THEN part ELSE substr(text, 1, {EXCERPT}) END, '^\s+|\s+$', '', 'g') AS excerpt FROM r WHERE i = 1""",
)
def best_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question and text found for it the window of the text that supports it most."""
    pairs = cited_pairs(spark, sf_dir).withColumn("answer", answer_parts(F.col("question")))
    return pairs.withColumn("b", best_excerpt("answer", "text")).select("item_id", "doc_id", "b.start", "b.score", "b.excerpt")


@register(
    "question_relevance",
    rf"""WITH {_pairs_sql()}, a AS (SELECT *, {_sql_meaning('question', 3)} AS words, {_sql_meaning('text', 3)} AS there, list_distinct(regexp_extract_all(question, '{NUMBER}')) AS figures, list_distinct(list_transform(regexp_extract_all(question, '{NAMED}'), lambda x: lower(x))) AS names FROM p),
w AS (SELECT item_id, doc_id, max({_sql_shared('words', 'part')}) AS near FROM (SELECT item_id, doc_id, words, {_sql_meaning(f'substr(text, start, {REACH})', 3)} AS part FROM (SELECT *, unnest(range(1, greatest(length(text), 1) + 1, {REACH // 2})) AS start FROM a) x) y GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(CASE WHEN len(words) = 0 OR len(there) = 0 THEN found ELSE 0.25::DOUBLE * found + 0.15::DOUBLE * {_sql_shared('words', 'there')} + 0.15::DOUBLE * near
  + 0.25::DOUBLE * CASE WHEN len(names) > 0 THEN len(list_filter(names, lambda n: contains(lower(text), n))) / len(names)::DOUBLE ELSE 0.0 END + 0.1::DOUBLE * {_sql_shared('figures', f"list_distinct(regexp_extract_all(text, '{NUMBER}'))")} END + 1e-9, 6) AS relevance FROM a JOIN w USING (item_id, doc_id)""",
)
def question_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted parts of a text's relevance to its question: how it was found, shared words, the best window's, names, figures."""
    q, t = F.col("question"), F.col("text")
    pairs = cited_pairs(spark, sf_dir).withColumn("words", meaning(q, 3, ANSWER_STOP_WORDS)).withColumn("figures", numbers(q)).withColumn("there", meaning(t, 3, ANSWER_STOP_WORDS))
    names = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(NAMED), F.lit(0)), lambda x: F.lower(x)))
    named = F.when(F.size(names) > 0, F.size(F.filter(names, lambda n: F.contains(F.lower(t), n))) / F.size(names)).otherwise(0.0)
    near = F.array_max(F.transform(windows(t, REACH), lambda w: shared(F.col("words"), meaning(w["text"], 3, ANSWER_STOP_WORDS))))
    whole = 0.25 * F.col("found") + 0.15 * shared(F.col("words"), F.col("there")) + 0.15 * near + 0.25 * named + 0.1 * shared(F.col("figures"), numbers(t))
    relevance = F.when((F.size("words") == 0) | (F.size("there") == 0), F.col("found")).otherwise(whole)
    return pairs.select("item_id", "doc_id", F.round(relevance + 1e-9, 6).alias("relevance"))
