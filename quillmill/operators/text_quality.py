"""Text statistics, redaction, sanitising, rules, grounding and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.vectors import jaccard
from quillmill.plans.catalogue import register
from quillmill.sources.views import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@register(
    "token_stats",
    """SELECT doc_id, len(t) AS n_tokens, coalesce(list_max(list_transform(t, lambda w: length(w))), 0) AS longest, len(list_filter(t, lambda w: regexp_matches(w, '^[0-9]+$'))) AS n_numbers
FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+'), lambda w: length(w) >= 2)) AS t FROM documents) x""",
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.coalesce(F.array_max(F.transform("t", F.length)), F.lit(0)).cast("long").alias("longest"),
        F.size(F.filter("t", lambda w: w.rlike("^[0-9]+$"))).cast("long").alias("n_numbers"),
    )


@register(
    "trigram_overlap",
    """WITH s AS (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS s FROM benchmark), g AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3))) AS g FROM s)
SELECT a.item_id, round(len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)), 6) AS overlap, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS jaccard
FROM g a JOIN g b ON b.item_id = a.item_id + 1""",
)
def trigram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the character groups of neighbouring questions."""
    g = table(spark, sf_dir, "benchmark").select("item_id", T.character_grams(F.col("text")).alias("g"))
    other = g.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return g.join(other, "item_id").select("item_id", F.round(T.overlap(F.col("g"), F.col("h")), 6).alias("overlap"), F.round(jaccard(F.col("g"), F.col("h"), 0.0), 6).alias("jaccard"))


@register(
    "logical_ids",
    """SELECT p_partkey, 'market:' || upper(p_brand) || ':en:' || lower(p_type) || ':' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 96), ''), 'document') AS logical_id,
  sha256(p_name || '|' || p_type) AS content_hash FROM part""",
)
def logical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", T.logical_id(F.lit("market"), F.col("p_brand"), F.lit("en"), F.col("p_type"), F.col("p_name")).alias("logical_id"), F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("content_hash")
    )


@register(
    "key_phrases",
    """WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3) AS w FROM benchmark),
p AS (SELECT item_id, w, list_concat(list_concat(list_transform(range(1, greatest(len(w) - 3, 0) + 1), lambda i: array_to_string(w[i:i+3], ' ')), list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda i: array_to_string(w[i:i+2], ' '))),
  list_transform(range(1, greatest(len(w) - 1, 0) + 1), lambda i: array_to_string(w[i:i+1], ' '))) AS p FROM t)
SELECT item_id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:12] AS phrases FROM p""",
)
def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    return b.select("item_id", T.key_phrases(F.col("w")).alias("phrases"))


@register(
    "url_parts",
    """SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto', 'tel') AS allowed FROM pages""",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    scheme = F.lower(F.regexp_extract(u, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return table(spark, sf_dir, "pages").select(
        "page_id", scheme.alias("scheme"), F.lower(F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1)).alias("host"), F.regexp_extract(u, "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), scheme.isin(*T.SCHEMES).alias("allowed")
    )


#: Phrases of the risk policies, with the level and the action of each policy.
POLICIES = {
    "medical": ("WARN", 1, ("cure", "heals", "treats", "prevents disease")),
    "income": ("REFUSE", 3, ("guaranteed income", "get rich", "passive income guaranteed")),
    "earnings": ("REFUSE", 3, ("the earnings",)),
    "common": ("REVIEW", 2, ("the and", "des les", "der die")),
}
LONGEST_INPUT = 25_000
_CASES = [f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{k}' END" for k, (_, _, ps) in POLICIES.items()]
_RANK = "CASE f WHEN 'medical' THEN 1 WHEN 'common' THEN 2 WHEN 'income' THEN 3 WHEN 'earnings' THEN 3 WHEN 'too_long' THEN 3 ELSE 0 END"


@register(
    "risk_flags",
    f"""WITH x AS (SELECT doc_id, list_filter([{', '.join(_CASES)}, CASE WHEN length(t) > {LONGEST_INPUT} THEN 'too_long' END], lambda p: p IS NOT NULL) AS flags FROM (SELECT doc_id, lower(text) AS t FROM documents) y),
r AS (SELECT *, coalesce(list_max(list_transform(flags, lambda f: {_RANK})), 0) AS worst FROM x)
SELECT doc_id, flags, CASE worst WHEN 3 THEN 'REFUSE' WHEN 2 THEN 'REVIEW' WHEN 1 THEN 'WARN' ELSE 'ALLOW' END AS action, worst < 3 AS allowed FROM r""",
)
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies by phrases in one projection, and the worst action by rank."""
    t = F.lower("text")

    def any_of(phrases):
        found = F.lit(False)
        for p in phrases:
            found = found | t.contains(p)
        return found

    ranked = [F.when(any_of(ps), F.struct(F.lit(k).alias("k"), F.lit(rank).alias("r"))) for k, (_, rank, ps) in POLICIES.items()]
    ranked.append(F.when(F.length(t) > LONGEST_INPUT, F.struct(F.lit("too_long").alias("k"), F.lit(3).alias("r"))))
    d = docs(spark, sf_dir).select("doc_id", F.array_compact(F.array(*ranked)).alias("f"))
    worst = F.coalesce(F.array_max(F.transform("f", lambda x: x["r"])), F.lit(0))
    action = F.when(worst == 3, "REFUSE").when(worst == 2, "REVIEW").when(worst == 1, "WARN").otherwise("ALLOW")
    return d.select("doc_id", F.transform("f", lambda x: x["k"]).alias("flags"), action.alias("action"), (worst < 3).alias("allowed"))


@register(
    "route_reasons",
    """SELECT conv_id, turn, list_filter([CASE WHEN length(text) > 600 THEN 'long' END, CASE WHEN length(text) - length(replace(text, '?', '')) > 1 THEN 'several_questions' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'numbers' END,
  CASE WHEN length(text) - length(replace(text, chr(10), '')) >= 3 THEN 'many_lines' END], lambda x: x IS NOT NULL) AS reasons,
  CASE WHEN length(text) > 600 OR length(text) - length(replace(text, '?', '')) > 1 OR regexp_matches(text, '[0-9]') OR length(text) - length(replace(text, chr(10), '')) >= 3 THEN 'complex' ELSE 'fast' END AS target
FROM conversations WHERE role = 'user'""",
)
def route_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural reasons of a question; any makes its route the complex one."""
    t = F.col("text")
    count = lambda c: F.length(t) - F.length(F.translate(t, c, ""))
    reasons = F.array_compact(F.array(F.when(F.length(t) > 600, "long"), F.when(count("?") > 1, "several_questions"), F.when(t.rlike("[0-9]"), "numbers"), F.when(count("\n") >= 3, "many_lines")))
    d = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", reasons.alias("reasons"))
    return d.withColumn("target", F.when(F.size("reasons") > 0, "complex").otherwise("fast"))


@register(
    "validation_issues",
    """SELECT doc_id, list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN length(text) > 10000 THEN 'too_long' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END,
  CASE WHEN length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) OR length(text) - length(replace(text, '[', '')) <> length(text) - length(replace(text, ']', '')) THEN 'broken_ending' END], lambda x: x IS NOT NULL) AS issues,
  NOT (trim(text) = '' OR length(text) > 10000) AS valid FROM documents""",
)
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as columns; errors (empty, too long) make a row invalid, warnings don't."""
    t = F.col("text")
    empty, long = F.trim(t) == "", F.length(t) > 10_000
    issues = F.array_compact(F.array(F.when(empty, "empty"), F.when(long, "too_long"), F.when(~F.col("lang").isin("en", "de", "fr"), "language"), F.when(T.unbalanced(t), "broken_ending")))
    return docs(spark, sf_dir).select("doc_id", issues.alias("issues"), (~(empty | long)).alias("valid"))


@register(
    "evidence_approval",
    """SELECT p_partkey, CASE WHEN p_brand <> 'Brand#1' AND (p_size / 50.0 >= 0.47 OR (p_size / 50.0 >= 0.3 AND p_retailprice >= 1000)) THEN 'approved' WHEN p_brand = 'Brand#1' THEN 'locale' ELSE 'low_confidence' END AS decision FROM part""",
)
def evidence_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locale must match, and the confidence be high, or moderate with a good score."""
    c, local = F.col("p_size") / 50.0, F.col("p_brand") != "Brand#1"
    good = (c >= 0.47) | ((c >= 0.3) & (F.col("p_retailprice") >= 1000))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(local & good, "approved").when(~local, "locale").otherwise("low_confidence").alias("decision"))


@register(
    "evidence_contract",
    """SELECT event_id, CASE WHEN k IS NULL THEN 'not_json' WHEN k < 0 OR k > 90 THEN 'unknown_id' WHEN k % 10 = 0 THEN 'unsupported_claim' WHEN k % 7 = 0 THEN 'incomplete' ELSE 'accepted' END AS verdict
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) t""",
)
def evidence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON contract is parsed and judged by ordered rules; the first that fails names the rejection."""
    k = F.from_json("props", "k int")["k"]
    verdict = F.when(k.isNull(), "not_json").when((k < 0) | (k > 90), "unknown_id").when(k % 10 == 0, "unsupported_claim").when(k % 7 == 0, "incomplete").otherwise("accepted")
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"))


@register(
    "year_coverage",
    """WITH q AS (SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS y, list_sort(list_distinct(list(CAST(strftime(l_shipdate, '%Y') AS INTEGER)))) AS seen FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT o_orderkey, y, list_contains(seen, y) OR (y >= list_min(seen) AND y <= list_max(seen)) AS covered FROM q""",
)
def year_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a requested year among the evidence's years, or between them?"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.year("l_shipdate")).alias("seen"))
    covered = F.array_contains("seen", F.col("y")) | ((F.col("y") >= F.array_min("seen")) & (F.col("y") <= F.array_max("seen")))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "y", covered.alias("covered"))


@register(
    "citation_support",
    """WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents),
p AS (SELECT item_id, doc_id, len(list_intersect(b.w, d.w)) / len(b.w) AS share FROM b JOIN (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, unnest(w) AS t FROM b) x JOIN (SELECT doc_id, unnest(w) AS t FROM d) y USING (t)) c USING (item_id) JOIN d USING (doc_id) WHERE len(b.w) > 0)
SELECT item_id, count(*) FILTER (WHERE share >= 0.35) AS supported, round(max(share), 6) AS best FROM p GROUP BY item_id""",
)
def citation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts support a statement: the share of its words that they hold, counted through an equi-join on words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    d = docs(spark, sf_dir).select("doc_id", F.explode(words).alias("t"))
    asked = d.join(b.select("t").distinct(), "t", "left_semi")
    share = asked.join(b, "t").groupBy("item_id", "n", "doc_id").agg((F.count("*") / F.first("n")).alias("share"))
    return share.groupBy("item_id").agg(F.count_if(F.col("share") >= 0.35).alias("supported"), F.round(F.max("share"), 6).alias("best"))


@register("pii_redaction")
def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "text", T.redacted("text").alias("clean"))
    return d.select("doc_id", (F.col("text") != F.col("clean")).alias("changed"), F.substring(T.squeezed(F.col("clean")), 1, 800).alias("preview"))


@register("html_sanitize")
def html_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", T.sanitised("html").alias("safe"), T.plain_html("html").alias("plain"))
    return p.select("page_id", "safe", "plain", F.sha2("plain", 256).alias("content_hash"))


@register("normal_forms")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.sha2(T.folded("text"), 256).alias("folded_hash"), F.sha2(T.without_accents("text"), 256).alias("plain_hash"))


@register("typo_distance")
def typo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known words within two edits of a question's longest words: candidates share a deletion, so no cross join is needed."""
    from quillmill.functions.repair import repair_candidates

    return repair_candidates(spark, sf_dir)
