"""Lookups, glossaries, scores by rule, scopes, cache and evaluation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.vectors import cosine, jaccard
from quillmill.plans.catalogue import register
from quillmill.sources.views import INTERACTIONS, interactions, table, with_views

#: Fixed values of the examples: glossary triggers, the locale each is for (* is any), and what they are expanded to.
GLOSSARY = [("to", "*", "direction"), ("the and", "en", "article pair"), ("der", "de", "artikel"), ("eau", "fr", "water"), ("que", "*", "relative"), ("in", "de", "preposition"), ("on the", "en", "place")]


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") AS {names}"


@register(
    "glossary_matches",
    f"""SELECT conv_id, turn, list_sort(list(expansion)) AS expansions FROM conversations c JOIN {_values(GLOSSARY, 'g(trigger, locale, expansion)')}
  ON (g.locale = '*' OR g.locale = CASE WHEN c.conv_id % 2 = 0 THEN 'en' ELSE 'fr' END) AND CASE WHEN length(trigger) <= 3 THEN regexp_matches(lower(text), '(^|[^a-z])' || trigger || '([^a-z]|$)') ELSE contains(lower(text), trigger) END
WHERE role = 'user' GROUP BY conv_id, turn""",
)
def glossary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of a locale that a message holds: a bounded list in the plan, so no join is needed. Short ones need word borders."""
    t, locale = F.lower("text"), F.when(F.col("conv_id") % 2 == 0, "en").otherwise("fr")

    def hit(trigger: str, where: str):
        held = t.rlike(f"(^|[^a-z]){trigger}([^a-z]|$)") if len(trigger) <= 3 else t.contains(trigger)
        return held if where == "*" else held & (locale == where)

    found = F.array_compact(F.array(*[F.when(hit(trigger, where), F.lit(e)) for trigger, where, e in GLOSSARY]))
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_sort(found).alias("expansions")).filter(F.size("expansions") > 0)


@register(
    "market_mentions",
    """SELECT r_name, count(*) AS n FROM region r JOIN (SELECT ' ' || regexp_replace(lower(n_name || ' of ' || r_name), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM nation JOIN region ON n_regionkey = r_regionkey) m
  ON contains(m.t, ' ' || lower(r.r_name) || ' ') AND length(r_name) > 2 GROUP BY r_name""",
)
def market_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole names of markets in a text, by an equi-join of the names' words with the text's windows of as many words."""
    regions = table(spark, sf_dir, "region").filter(F.length("r_name") > 2).select("r_name", F.lower("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_name", "in_region"), F.col("n_regionkey") == F.col("r_regionkey"))
    words = F.split(F.trim(F.regexp_replace(F.lower(F.concat("n_name", F.lit(" of "), "in_region")), "[^a-z0-9]+", " ")), " ")
    longest = regions.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    window = lambda k: F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))
    said = n.select("n_nationkey", words.alias("w")).select("n_nationkey", F.explode(F.array_distinct(F.flatten(F.array(*[window(k) for k in range(1, longest + 1)])))).alias("name"))
    return said.join(regions, "name").groupBy("r_name").agg(F.count("*").alias("n"))


@register(
    "config_overrides",
    """SELECT c_custkey, coalesce(nullif(CASE c_mktsegment WHEN 'BUILDING' THEN 'build@x' WHEN 'MACHINERY' THEN '' END, ''), 'default@x') AS contact, least(coalesce(CASE WHEN c_acctbal > 5000 THEN 10 END, 5), 8) AS retries FROM customer""",
)
def config_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market's value, or the default where it has none or an empty one."""
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "build@x").when(F.col("c_mktsegment") == "MACHINERY", "")
    retries = F.least(F.coalesce(F.when(F.col("c_acctbal") > 5000, 10), F.lit(5)), F.lit(8))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.nullif(segment, F.lit("")), F.lit("default@x")).alias("contact"), retries.alias("retries"))


@register(
    "user_scopes",
    """SELECT n_nationkey, coalesce(list_sort(list(DISTINCT s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL)), []) AS scopes, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey GROUP BY n_nationkey""",
)
def user_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of each user, an empty list where there are none."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.array_sort(F.collect_set("s_suppkey")).alias("scopes"))
    n = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    scopes = F.coalesce("scopes", F.array().cast("array<bigint>"))
    return n.select("n_nationkey", scopes.alias("scopes"), F.size(scopes).cast("long").alias("n"))


@register(
    "reclassified_traffic",
    with_views(INTERACTIONS, body="""SELECT source, count(*) AS n FROM (SELECT CASE WHEN starts_with('csv-' || topic, 'csv-topic-1') THEN 'evaluation' WHEN created_at < TIMESTAMP '2024-01-05 00:00:00' THEN 'legacy' ELSE traffic_source END AS source FROM interactions) t GROUP BY source"""),
)
def reclassified_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation sessions by their prefix, and all before a date as legacy."""
    source = F.when(F.concat(F.lit("csv-"), "topic").startswith("csv-topic-1"), "evaluation").when(F.col("created_at") < F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), "legacy").otherwise(F.col("traffic_source"))
    return interactions(spark, sf_dir).groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@register(
    "filter_tree",
    """SELECT doc_id FROM documents WHERE (lang = 'en' OR source = 'src0') AND source IN ('src0', 'src1', 'src2') AND NOT (n_chars > 20000) AND regexp_matches(lower(text), '(^|[^a-z0-9_])(the|und|que)($|[^a-z0-9_])')""",
)
def filter_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locale or global scope, sources, sizes and a word-bounded pattern: plain predicates go down to the scan."""
    d = table(spark, sf_dir, "documents").filter((F.col("lang") == "en") | (F.col("source") == "src0")).filter(F.col("source").isin("src0", "src1", "src2"))
    return d.filter(~(F.col("n_chars") > 20_000)).filter(F.lower("text").rlike(r"(^|[^a-z0-9_])(the|und|que)($|[^a-z0-9_])")).select("doc_id")


@register(
    "keyset_page",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100",
)
def keyset_page(spark: SparkSession, sf_dir: str, after: int = 1000, size: int = 100) -> DataFrame:
    """A page after a key, in order of the key."""
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") > after).orderBy("o_orderkey").limit(size).select("o_orderkey", "o_custkey")


@register(
    "ordered_digest",
    """SELECT conv_id, arg_min(role, turn) AS first_role, count(*) AS n, sha256(string_agg(sha256(text), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""",
)
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row, count and a digest of the rows in order; only digests of rows are gathered."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2("text", 256).alias("h"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "h"))), lambda x: x["h"]), ""), 256)
    return c.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.count("*").alias("n"), digest.alias("digest"))


@register(
    "evidence_fingerprint",
    """SELECT l_orderkey, sha256(string_agg(CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR), '|' ORDER BY l_partkey, l_suppkey)) AS fingerprint FROM lineitem GROUP BY l_orderkey""",
)
def evidence_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest that does not depend on the order of what it covers."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey"))), lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(parts, "|"), 256).alias("fingerprint"))


@register(
    "semantic_cache_hits",
    """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (
  SELECT q.vec_id AS query_id, d.vec_id, d.label, list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v))) AS s FROM u q JOIN u d ON q.label = d.label OR true WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rk FROM p)
SELECT a.query_id, a.vec_id, round(a.s - b.s, 6) AS margin, NOT (a.label <> b.label AND a.s - b.s < 0.02) AS hit FROM r a JOIN r b USING (query_id) WHERE a.rk = 1 AND b.rk = 2""",
)
def semantic_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cached answer, unless a different one is nearly as good."""
    from quillmill.operators.retrieval import vector_best

    two = vector_best(spark, sf_dir, 2, positive=False).withColumnsRenamed({"score": "s", "rank": "r"})
    one = F.struct(F.col("vec_id").alias("id"), "label", "s")
    second = two.groupBy("query_id").agg(F.min_by(one, "r").alias("a"), F.max_by(one, "r").alias("b"), F.count("*").alias("k")).filter("k = 2")
    margin = F.col("a.s") - F.col("b.s")
    return second.select("query_id", F.col("a.id").alias("vec_id"), F.round(margin, 6).alias("margin"), (~((F.col("a.label") != F.col("b.label")) & (margin < 0.02))).alias("hit"))


@register(
    "label_centroids",
    """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), e AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM u) t GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM e GROUP BY label)
SELECT label, count(*) AS n, round(avg(list_inner_product(v, c) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(c, c)))), 6) AS cohesion FROM u JOIN c USING (label) GROUP BY label""",
)
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, and how close its members are to it."""
    v = table(spark, sf_dir, "embeddings")
    mean = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    return v.join(centre, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cosine(F.col("embedding"), F.col("c"))), 6).alias("cohesion"))


@register(
    "section_scores",
    """WITH q AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w, p_type, p_size FROM part)
SELECT p_partkey, round(p_size / 50.0::DOUBLE + CASE WHEN p_brand = 'Brand#7' THEN 0.75 ELSE 0 END + CASE WHEN list_contains(w, 'red') THEN 0.8 ELSE 0 END
  + 0.35::DOUBLE * len(list_intersect(w, ['red', 'bolt', 'small'])) / 3 + CASE WHEN array_to_string(w, ' ') = 'red bolt' THEN 0.35 WHEN list_contains(w, 'bolt') THEN 0.12 ELSE 0 END, 6) AS score FROM q""",
)
def section_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's score: base, id, title word, share of the question's words, phrase."""
    w = F.split("p_name", " ")
    asked = F.array(*[F.lit(x) for x in ("red", "bolt", "small")])
    phrase = F.when(F.col("p_name") == "red bolt", 0.35).when(F.array_contains(w, "bolt"), 0.12).otherwise(0.0)
    score = F.col("p_size") / 50.0 + F.when(F.col("p_brand") == "Brand#7", 0.75).otherwise(0.0) + F.when(F.array_contains(w, "red"), 0.8).otherwise(0.0) + 0.35 * F.size(F.array_intersect(w, asked)) / 3 + phrase
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@register(
    "best_of_queries",
    """SELECT p_brand, p_partkey, round(max(s), 6) AS score, arg_max(q, (s, q)) AS query FROM (SELECT p_brand, p_partkey, 'size' AS q, p_size / 50.0::DOUBLE AS s FROM part UNION ALL SELECT p_brand, p_partkey, 'price', p_retailprice / 2000.0 + CASE WHEN p_type = 'SMALL' THEN 2 ELSE 0 END FROM part) t GROUP BY p_brand, p_partkey""",
)
def best_of_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score over several forms of a question, and which gave it."""
    by_size = F.struct((F.col("p_size") / 50.0).alias("s"), F.lit("size").alias("q"))
    by_price = F.struct((F.col("p_retailprice") / 2000.0 + F.when(F.col("p_type") == "SMALL", 2).otherwise(0)).alias("s"), F.lit("price").alias("q"))
    best = F.array_max(F.array(by_size, by_price))
    return table(spark, sf_dir, "part").withColumn("b", best).select("p_brand", "p_partkey", F.round("b.s", 6).alias("score"), F.col("b.q").alias("query"))


@register(
    "country_scores",
    """SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 8.0::DOUBLE WHEN c_nationkey % 5 = 0 THEN 6.0 ELSE -4.0 END + CASE WHEN c_name LIKE '%77' THEN 2.4 WHEN c_mktsegment = 'BUILDING' THEN 2.2 ELSE 0 END AS score FROM customer""",
)
def country_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, mentioned or other country, and a bonus by the kind of match."""
    place = F.when(F.col("c_nationkey") == 3, 8.0).when(F.col("c_nationkey") % 5 == 0, 6.0).otherwise(-4.0)
    bonus = F.when(F.col("c_name").like("%77"), 2.4).when(F.col("c_mktsegment") == "BUILDING", 2.2).otherwise(0.0)
    return table(spark, sf_dir, "customer").select("c_custkey", (place + bonus).alias("score"))


@register(
    "score_coercion",
    """SELECT event_id, CASE WHEN s > 1 AND s <= 100 THEN s / 100 WHEN s >= 0 AND s <= 1 THEN s END AS score FROM (SELECT event_id, coalesce(CASE WHEN value > 300 THEN NULL ELSE value END, CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS s FROM events) t""",
)
def score_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid of several score fields, brought to 0..1."""
    s = F.coalesce(F.when(F.col("value") <= 300, F.col("value")), F.get_json_object("props", "$.k").cast("double"))
    return table(spark, sf_dir, "events").select("event_id", F.when((s > 1) & (s <= 100), s / 100).when((s >= 0) & (s <= 1), s).alias("score"))


@register(
    "claim_scope",
    """SELECT doc_id, contains(t, 'the') AND (contains(t, 'reand') OR contains(t, 'tion')) AND regexp_matches(t, 'idiot|clown|loser') AS in_scope FROM (SELECT doc_id, lower(text) AS t FROM documents) x""",
)
def claim_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text is in scope of a claim rule if it has a term of each of three lists."""
    t = F.lower("text")
    lists = (("the",), ("reand", "tion"), ("idiot", "clown", "loser"))
    scope = F.lit(True)
    for terms in lists:
        any_of = F.lit(False)
        for term in terms:
            any_of = any_of | t.contains(term)
        scope = scope & any_of
    return table(spark, sf_dir, "documents").select("doc_id", scope.alias("in_scope"))


@register(
    "follow_ups",
    """WITH m AS (SELECT conv_id, turn, role, text, len(string_split_regex(trim(text), '\\s+')) <= 14 AS short FROM conversations), u AS (SELECT *, CASE WHEN role = 'user' AND NOT short THEN turn END AS own FROM m)
SELECT conv_id, turn, short AS follow_up, max(own) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM u""",
)
def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short turns follow up; their anchor is the latest user turn before that stands for itself."""
    short = F.size(F.split(F.trim("text"), r"\s+")) <= 14
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").withColumn("follow_up", short).withColumn("own", F.when((F.col("role") == "user") & ~F.col("follow_up"), F.col("turn")))
    return c.select("conv_id", "turn", "follow_up", F.max("own").over(w).alias("anchor"))


@register(
    "translation_check",
    """WITH p AS (SELECT a.conv_id, a.turn, a.text AS s, b.text AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, regexp_extract_all(s, '[0-9]+') = regexp_extract_all(t, '[0-9]+') AS same_numbers, length(t) <= greatest(800, 4 * length(s)) AS right_length, len(list_filter(regexp_extract_all(t, 'https?://[^ ]+'), lambda x: NOT contains(s, x))) = 0 AS no_new_links FROM p""",
)
def translation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reserved text and its translation (here: the next turn): same numbers, no new links, bounded length."""
    c = table(spark, sf_dir, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("s")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    numbers = lambda x: F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
    links = F.filter(F.regexp_extract_all("t", F.lit("https?://[^ ]+"), F.lit(0)), lambda x: ~F.contains(F.col("s"), x))
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", (numbers(F.col("s")) == numbers(F.col("t"))).alias("same_numbers"), (F.length("t") <= F.greatest(F.lit(800), 4 * F.length("s"))).alias("right_length"), (F.size(links) == 0).alias("no_new_links")
    )


@register(
    "shadow_answers",
    with_views(INTERACTIONS, body="""SELECT correlation_id, round(CASE WHEN len(reasons) = 0 THEN 0.0 ELSE len(list_intersect(reasons, ['r1', 's2'])) / len(list_distinct(list_concat(reasons, ['r1', 's2']))) END, 4) AS agreement,
  CASE WHEN len(reasons) = 0 THEN 'miss' WHEN list_contains(reasons, 'r1') AND list_contains(reasons, 's2') THEN 'agree' ELSE 'review' END AS decision, CASE WHEN len(reasons) > 0 THEN input_tokens + output_tokens ELSE 0 END AS tokens_saved FROM interactions"""),
)
def shadow_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached answer against the fresh one; tokens are saved only where there was a candidate."""
    r, want = F.col("reasons"), F.array(F.lit("r1"), F.lit("s2"))
    decision = F.when(F.size(r) == 0, "miss").when(F.array_contains(r, "r1") & F.array_contains(r, "s2"), "agree").otherwise("review")
    agreement = F.when(F.size(r) == 0, 0.0).otherwise(F.round(jaccard(r, want, 0.0), 4))
    return interactions(spark, sf_dir).select("correlation_id", agreement.alias("agreement"), decision.alias("decision"), F.when(F.size(r) > 0, F.col("input_tokens") + F.col("output_tokens")).otherwise(0).alias("tokens_saved"))


@register(
    "cache_purge",
    with_views(INTERACTIONS, body="""SELECT key FROM (SELECT DISTINCT 'answer:' || lower(country) || ':' || language || ':' || topic AS key FROM interactions) t WHERE regexp_matches(key, '^answer:nation_(1|2|3):') AND NOT contains(key, 'topic-1')"""),
)
def cache_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of a family and of allowed markets that do not hold a listed phrase."""
    key = F.concat_ws(":", F.lit("answer"), F.lower("country"), "language", "topic")
    keys = interactions(spark, sf_dir).select(key.alias("key")).distinct()
    return keys.filter(F.col("key").rlike("^answer:nation_(1|2|3):") & ~F.col("key").contains("topic-1"))


@register(
    "range_lookup",
    """WITH bands(low, high, band) AS (VALUES (0.0, 999.99, 'low'), (1000.0, 4999.99, 'middle'), (5000.0, 1e9, 'high'), (-1e9, -0.01, 'debt')) SELECT band, count(*) AS n FROM customer JOIN bands ON c_acctbal >= low AND c_acctbal <= high GROUP BY band""",
)
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first inclusive range that holds a value, as an expression over the bounded list of ranges."""
    b = F.col("c_acctbal")
    bands = [(0.0, 999.99, "low"), (1000.0, 4999.99, "middle"), (5000.0, 1e9, "high"), (-1e9, -0.01, "debt")]
    band = F.coalesce(*[F.when((b >= low) & (b <= high), F.lit(name)) for low, high, name in bands])
    return table(spark, sf_dir, "customer").select(band.alias("band")).filter("band is not null").groupBy("band").agg(F.count("*").alias("n"))


@register(
    "canary_checks",
    """SELECT item_id, contains(lower(text), 'the') AS title_ok, length(text) / 1000.0::DOUBLE >= 0.25 AS confidence_ok, item_id % 9 <> 0 AS approved, contains(lower(text), 'the') AND length(text) / 1000.0::DOUBLE >= 0.25 AND item_id % 9 <> 0 AS passed FROM benchmark""",
)
def canary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, confidence and approval of the expected evidence; all must hold."""
    title, confidence, approved = F.lower("text").contains("the"), F.length("text") / 1000.0 >= 0.25, F.col("item_id") % 9 != 0
    return table(spark, sf_dir, "benchmark").select("item_id", title.alias("title_ok"), confidence.alias("confidence_ok"), approved.alias("approved"), (title & confidence & approved).alias("passed"))


@register(
    "plan_cleaning",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(text, '[?]\\s*$') THEN 'question' WHEN length(text) < 200 THEN 'short' WHEN item_id % 4 = 0 THEN 'no_source' ELSE 'usable' END AS kind FROM benchmark) t GROUP BY kind""",
)
def plan_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a test plan by ordered rules."""
    t = F.col("text")
    kind = F.when(F.trim(t) == "", "empty").when(t.rlike(r"[?]\s*$"), "question").when(F.length(t) < 200, "short").when(F.col("item_id") % 4 == 0, "no_source").otherwise("usable")
    return table(spark, sf_dir, "benchmark").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@register(
    "set_checks",
    """SELECT conv_id, len(list_filter(roles, lambda r: NOT list_contains(['user', 'assistant', 'system'], r))) = 0 AS known_roles, list_sort(list_filter(['user', 'assistant', 'system'], lambda r: NOT list_contains(roles, r))) AS absent FROM (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id) t""",
)
def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset and difference of what a group has and what it should have."""
    want = F.array(*[F.lit(x) for x in ("user", "assistant", "system")])
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return c.select("conv_id", (F.size(F.array_except("roles", want)) == 0).alias("known_roles"), F.array_sort(F.array_except(want, F.col("roles"))).alias("absent"))


@register(
    "query_expansion",
    """SELECT item_id, list_distinct([text, 'info ' || left(text, 20), left(text, 20)])[1:4] IS NOT NULL AS has_queries, len(list_distinct([text, 'info ' || left(text, 20), left(text, 20), text])) AS n_queries FROM benchmark""",
)
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of a question in order, distinct, the first four."""
    head = F.substring("text", 1, 20)
    forms = F.slice(F.array_distinct(F.array(F.col("text"), F.concat(F.lit("info "), head), head, F.col("text"))), 1, 4)
    return table(spark, sf_dir, "benchmark").select("item_id", forms.isNotNull().alias("has_queries"), F.size(forms).cast("long").alias("n_queries"))


@register(
    "planner_parse",
    """SELECT event_id, CASE WHEN k % 3 = 0 THEN 'lookup' ELSE 'general' END AS intent, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (k - 10) / 80.0::DOUBLE)) AS confidence FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) t""",
)
def planner_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planner's JSON, with intents from a list and the confidence clamped."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 3 == 0, "lookup").otherwise("general").alias("intent"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - 10) / 80.0)).alias("confidence"))


@register(
    "section_references",
    """SELECT doc_id, replace(regexp_extract(t, '(?:§|section|sec\\.?)\\s*(\\d+(?:[.-]\\d+)*)', 1), '-', '.') AS reference FROM (SELECT p_partkey AS doc_id, 'see section ' || CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey % 9 AS VARCHAR) AS t FROM part) x""",
)
def section_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = F.concat(F.lit("see section "), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 9).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), T.section_reference(spoken).alias("reference"))


@register(
    "priority_first",
    """SELECT o_custkey, arg_min(o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END, o_orderkey)) AS chosen FROM orders GROUP BY o_custkey""",
)
def priority_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key: a preferred one if there is any, else the first."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(rank.alias("r"), "o_orderkey")).alias("chosen"))


@register(
    "schema_difference",
    """SELECT name FROM (VALUES ('doc_id'), ('text'), ('lang'), ('source'), ('n_chars'), ('status'), ('generation')) r(name) WHERE name NOT IN (SELECT column_name FROM (DESCRIBE documents))""",
)
def schema_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required columns that a table lacks."""
    need = ("doc_id", "text", "lang", "source", "n_chars", "status", "generation")
    have = table(spark, sf_dir, "documents").columns
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in need])).alias("name"))
    return rows.filter(~F.col("name").isin(have))


@register(
    "generation_deletes",
    """SELECT source, lang, generation, n = expected AS deletable, CASE WHEN n = expected THEN 'deleted' ELSE 'kept' END AS status FROM (
  SELECT source, lang, doc_id // 50 AS generation, count(*) AS n, count(*) + CASE WHEN min(doc_id) % 7 = 0 THEN 1 ELSE 0 END AS expected FROM documents GROUP BY ALL) t""",
)
def generation_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation becomes a tombstone only if as many rows are found as were recorded."""
    g = table(spark, sf_dir, "documents").groupBy("source", "lang", F.expr("doc_id div 50").alias("generation"))
    g = g.agg(F.count("*").alias("n"), (F.count("*") + F.when(F.min("doc_id") % 7 == 0, 1).otherwise(0)).alias("expected"))
    ok = F.col("n") == F.col("expected")
    return g.select("source", "lang", "generation", ok.alias("deletable"), F.when(ok, "deleted").otherwise("kept").alias("status"))


@register(
    "artifact_cleanup",
    """SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS batch FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-06-01'""",
)
def artifact_cleanup(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """Retired artifacts in order of time, in batches.

    Days are numbered by the running sum of their counts (a row a day), and rows within their day, so no window holds all rows.
    """
    o = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")))
    o = o.select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"))
    days = o.groupBy("day").agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.sum("n").over(Window.orderBy("day")) - F.col("n")).select("day", "before")
    within = F.row_number().over(Window.partitionBy("day").orderBy("o_orderdate", "o_orderkey"))
    return o.withColumn("within", within).join(before, "day").select("o_orderkey", F.floor((F.col("before") + F.col("within") - 1) / size).alias("batch"))


@register(
    "allowed_citations",
    """SELECT l_orderkey, count(*) AS cited, count(*) FILTER (WHERE p_size >= 10) AS allowed, bool_and(coalesce(p_size >= 10, false)) AS all_allowed FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
)
def allowed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids that are among the approved ones, for each answer."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") >= 10).alias("ok"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    ok = F.coalesce("ok", F.lit(False))
    return li.groupBy("l_orderkey").agg(F.count("*").alias("cited"), F.count_if(ok).alias("allowed"), F.bool_and(ok).alias("all_allowed"))


@register(
    "local_relevance",
    """SELECT p_partkey, round(0.25::DOUBLE * p_size / 50 + 0.15::DOUBLE * (contains(p_name, 'red'))::INT + 0.15::DOUBLE * (p_retailprice > 1000)::INT + 0.25::DOUBLE * (contains(p_name, 'small bolt'))::INT + 0.1::DOUBLE * (p_partkey % 10 = 7)::INT + 0.1::DOUBLE * (p_type = 'SMALL')::INT, 6) AS relevance,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_type = 'SMALL' DESC, round(0.25::DOUBLE * p_size / 50 + 0.15::DOUBLE * (contains(p_name, 'red'))::INT + 0.15::DOUBLE * (p_retailprice > 1000)::INT + 0.25::DOUBLE * (contains(p_name, 'small bolt'))::INT + 0.1::DOUBLE * (p_partkey % 10 = 7)::INT + 0.1::DOUBLE * (p_type = 'SMALL')::INT, 6) DESC, p_partkey) AS rank FROM part""",
)
def local_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six weighted parts of relevance; ranked by heading, relevance and id."""
    one = lambda c: c.cast("int")
    n = F.col("p_name")
    heading = F.col("p_type") == "SMALL"
    parts = 0.25 * F.col("p_size") / 50 + 0.15 * one(n.contains("red")) + 0.15 * one(F.col("p_retailprice") > 1000) + 0.25 * one(n.contains("small bolt")) + 0.1 * one(F.col("p_partkey") % 10 == 7) + 0.1 * one(heading)
    p = table(spark, sf_dir, "part").withColumn("relevance", F.round(parts, 6)).withColumn("heading", heading)
    w = Window.partitionBy("p_brand").orderBy(F.desc("heading"), F.desc("relevance"), "p_partkey")
    return p.select("p_partkey", "relevance", F.row_number().over(w).cast("long").alias("rank"))


@register(
    "ordered_union",
    """SELECT p_brand, list_distinct_in_order AS parts FROM (SELECT p_brand, (list_filter(x, lambda e, i: list_position(x, e) = i))[1:8] AS list_distinct_in_order FROM (
  SELECT p_brand, list_concat(list(p_partkey ORDER BY p_retailprice DESC, p_partkey)[1:5], list(p_partkey ORDER BY p_size DESC, p_partkey)[1:5]) AS x FROM part GROUP BY p_brand) a) b""",
)
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected rows, then their neighbours, distinct and bounded."""
    from quillmill.operators.retrieval import ranked_lists

    lists = ranked_lists(spark, sf_dir).filter("r1 <= 5 or r2 <= 5")
    top = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col(r) <= 5, F.struct(r, "p_partkey")))), lambda x: x["p_partkey"])
    return lists.groupBy("p_brand").agg(F.slice(F.array_distinct(F.concat(top("r1"), top("r2"))), 1, 8).alias("parts"))
