"""Usage, feedback, routing and cost analytics over interactions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.filters import feedback_facet, market_scope, text_search, time_window, traffic
from quillmill.plans.catalogue import register
from quillmill.sources.views import FEEDBACK, INTERACTIONS, feedback, interactions, table, with_views

AS_OF = dt.datetime(2024, 1, 31)
SINCE = "created_at >= TIMESTAMP '2024-01-11 00:00:00' AND created_at < TIMESTAMP '2024-01-31 00:00:00'"
#: US dollars for a million tokens, in and out.
RATES = {"fast": (0.25, 1.25), "complex": (3.0, 15.0)}


def recent(spark: SparkSession, sf_dir: str, days: int = 20) -> DataFrame:
    return interactions(spark, sf_dir).filter(time_window(F.col("created_at"), AS_OF, days))


@register(
    "usage_overview",
    with_views(INTERACTIONS, body=f"""SELECT count(*) AS questions, count(DISTINCT session_id) AS sessions,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  round(coalesce(avg(confidence), 0), 6) AS avg_confidence, count(*) FILTER (WHERE fallback) AS fallbacks
FROM interactions WHERE {SINCE}"""),
)
def usage_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(spark, sf_dir).agg(
        F.count("*").alias("questions"),
        F.count_distinct("session_id").alias("sessions"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"),
        F.count_if("fallback").alias("fallbacks"),
    )


@register(
    "facet_topk",
    with_views(INTERACTIONS, body=f"SELECT topic, count(*) AS n FROM interactions WHERE {SINCE} GROUP BY topic ORDER BY n DESC, topic LIMIT 8"),
)
def facet_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(8)


@register(
    "locale_facets",
    with_views(INTERACTIONS, body=f"""SELECT country, language, count(*) AS n FROM interactions
WHERE {SINCE} AND upper(country) IN ('NATION_1', 'NATION_2', 'NATION_3') AND lower(traffic_source) = 'view' GROUP BY country, language"""),
)
def locale_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recent(spark, sf_dir).filter(market_scope(F.col("country"), None, {"nation_1", "nation_2", "nation_3"})).filter(traffic(F.col("traffic_source"), "view"))
    return rows.groupBy("country", "language").agg(F.count("*").alias("n"))


@register(
    "daily_trend",
    with_views(INTERACTIONS, body=f"""SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, count(*) AS questions,
  count(DISTINCT session_id) AS sessions, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens
FROM interactions WHERE {SINCE} GROUP BY 1"""),
)
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd").alias("day")
    return recent(spark, sf_dir).groupBy(day).agg(
        F.count("*").alias("questions"), F.count_distinct("session_id").alias("sessions"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")
    )


@register(
    "feedback_rates",
    with_views(INTERACTIONS, FEEDBACK, body="""SELECT count(*) FILTER (WHERE rating > 0) AS helpful, count(*) FILTER (WHERE rating < 0) AS not_helpful, count(*) AS events,
  count(*) FILTER (WHERE i.correlation_id IS NULL) AS orphans,
  CASE WHEN count(*) FILTER (WHERE rating <> 0) > 0 THEN round(count(*) FILTER (WHERE rating > 0) / count(*) FILTER (WHERE rating <> 0), 3) ELSE 0.0 END AS helpful_rate
FROM feedback f LEFT JOIN interactions i ON f.correlation_id = i.correlation_id
WHERE coalesce(i.created_at, f.created_at) >= TIMESTAMP '2024-01-01 00:00:00' AND coalesce(i.created_at, f.created_at) < TIMESTAMP '2024-01-31 00:00:00'"""),
)
def feedback_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings with their interaction, where there is one: its time is the event's time."""
    chat = interactions(spark, sf_dir).select("correlation_id", F.col("created_at").alias("asked_at"), F.lit(True).alias("known"))
    rows = feedback(spark, sf_dir).join(chat, "correlation_id", "left").filter(time_window(F.coalesce("asked_at", "created_at"), AS_OF, 30))
    rated = F.count_if(F.col("rating") != 0)
    helpful = F.count_if(F.col("rating") > 0)
    return rows.agg(
        helpful.alias("helpful"), F.count_if(F.col("rating") < 0).alias("not_helpful"), F.count("*").alias("events"),
        F.count_if(F.col("known").isNull()).alias("orphans"), F.when(rated > 0, F.round(helpful / rated, 3)).otherwise(0.0).alias("helpful_rate"),
    )


@register(
    "routing_totals",
    with_views(INTERACTIONS, body=f"""SELECT questions, cached, evaluated, fast, complex, fallbacks, greatest(0, questions - cached - evaluated) AS unclassified, avg_latency_ms FROM (
  SELECT count(*) AS questions, count(*) FILTER (WHERE cache_hit) AS cached, count(*) FILTER (WHERE route_target <> '') AS evaluated,
    count(*) FILTER (WHERE route_target = 'fast') AS fast, count(*) FILTER (WHERE route_target = 'complex') AS complex,
    count(*) FILTER (WHERE fallback) AS fallbacks, round(avg(latency_ms) FILTER (WHERE latency_ms > 1), 4) AS avg_latency_ms
  FROM interactions WHERE {SINCE}) t"""),
)
def routing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = recent(spark, sf_dir).agg(
        F.count("*").alias("questions"), F.count_if("cache_hit").alias("cached"), F.count_if(F.col("route_target") != "").alias("evaluated"),
        F.count_if(F.col("route_target") == "fast").alias("fast"), F.count_if(F.col("route_target") == "complex").alias("complex"), F.count_if("fallback").alias("fallbacks"),
        F.round(F.avg(F.when(F.col("latency_ms") > 1, F.col("latency_ms"))), 4).alias("avg_latency_ms"),
    )
    return totals.withColumn("unclassified", F.greatest(F.lit(0), F.col("questions") - F.col("cached") - F.col("evaluated")))


@register(
    "routing_by_target",
    with_views(INTERACTIONS, body=f"""SELECT route_target, count(*) AS questions, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  round(avg(latency_ms) FILTER (WHERE latency_ms > 0), 4) AS avg_latency_ms FROM interactions WHERE {SINCE} AND route_target IN ('fast', 'complex') GROUP BY route_target"""),
)
def routing_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recent(spark, sf_dir).filter(F.col("route_target").isin("fast", "complex"))
    return rows.groupBy("route_target").agg(
        F.count("*").alias("questions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), 4).alias("avg_latency_ms"),
    )


@register(
    "top_models",
    with_views(INTERACTIONS, body=f"SELECT actual_model, count(*) AS n FROM interactions WHERE {SINCE} AND actual_model <> '' GROUP BY actual_model ORDER BY n DESC, actual_model LIMIT 5"),
)
def top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(spark, sf_dir).filter("actual_model <> ''").groupBy("actual_model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actual_model").limit(5)


@register(
    "reason_counts",
    with_views(INTERACTIONS, body=f"SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM interactions WHERE {SINCE}) t GROUP BY reason ORDER BY n DESC, reason LIMIT 6"),
)
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions without reasons disappear."""
    return recent(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(6)


@register(
    "route_pivot",
    with_views(INTERACTIONS, body=f"""SELECT country, count(*) FILTER (WHERE route_target <> '') AS evaluated, count(*) FILTER (WHERE route_target = 'fast') AS fast,
  count(*) FILTER (WHERE route_target = 'complex') AS complex, count(*) FILTER (WHERE cache_hit) AS cached FROM interactions WHERE {SINCE} GROUP BY country"""),
)
def route_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(spark, sf_dir).groupBy("country").agg(
        F.count_if(F.col("route_target") != "").alias("evaluated"), F.count_if(F.col("route_target") == "fast").alias("fast"),
        F.count_if(F.col("route_target") == "complex").alias("complex"), F.count_if("cache_hit").alias("cached"),
    )


@register(
    "cost_projection",
    with_views(INTERACTIONS, body=f"""SELECT round(routed_usd, 6) AS routed_usd, round(current_usd, 6) AS current_usd, round(greatest(0.0, current_usd - routed_usd), 6) AS savings_usd FROM (
  SELECT sum(CASE route_target WHEN 'fast' THEN input_tokens * 0.25::DOUBLE + output_tokens * 1.25::DOUBLE ELSE input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE END) / 1000000 AS routed_usd,
    sum(input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000 AS current_usd
  FROM interactions WHERE {SINCE} AND route_target IN ('fast', 'complex')) t"""),
)
def cost_projection(spark: SparkSession, sf_dir: str, current: str = "complex") -> DataFrame:
    """Cost of the routed tokens against all of them at the current model's rate."""
    by_target = routing_by_target(spark, sf_dir)
    cost = lambda rate: F.col("input_tokens") * F.lit(rate[0]) + F.col("output_tokens") * F.lit(rate[1])
    routed = F.when(F.col("route_target") == "fast", cost(RATES["fast"])).otherwise(cost(RATES["complex"]))
    totals = by_target.agg((F.sum(routed) / 1e6).alias("r"), (F.sum(cost(RATES[current])) / 1e6).alias("c"))
    return totals.select(F.round("r", 6).alias("routed_usd"), F.round("c", 6).alias("current_usd"), F.round(F.greatest(F.lit(0.0), F.col("c") - F.col("r")), 6).alias("savings_usd"))


@register(
    "live_sessions",
    with_views(INTERACTIONS, body="""SELECT session_id, count(*) AS turns FROM interactions i
WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00' AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = i.session_id AND c.c_acctbal > 0)
  AND EXISTS (SELECT 1 FROM interactions j WHERE j.session_id = i.session_id AND j.traffic_source = 'signup')
GROUP BY session_id"""),
)
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unexpired sessions with consent (here: a positive balance) and traffic of a kind: semi-joins, nothing is duplicated."""
    rows = interactions(spark, sf_dir)
    consent = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("session_id"))
    sourced = rows.filter("traffic_source = 'signup'").select("session_id")
    live = rows.filter(F.col("created_at") >= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz"))
    return live.join(consent, "session_id", "left_semi").join(sourced, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("turns"))


@register(
    "latest_per_key",
    """SELECT c_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON c_custkey = o_custkey AND rn = 1""",
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer as an aggregate, which combines before the shuffle."""
    o = table(spark, sf_dir, "orders")
    latest = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    people = table(spark, sf_dir, "customer").select("c_custkey")
    return people.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o.o_orderkey", "o.o_orderstatus", F.round("o.o_totalprice", 2).alias("o_totalprice"))


def interaction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with their latest feedback, where there is any."""
    latest = feedback(spark, sf_dir).groupBy("correlation_id").agg(F.max_by("rating", F.struct("created_at", "event_id")).alias("rating"))
    return recent(spark, sf_dir).join(latest, "correlation_id", "left").withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))


_ROWS = f"""(SELECT i.*, f.rating, input_tokens + output_tokens AS tokens FROM interactions i LEFT JOIN (
  SELECT correlation_id, rating, row_number() OVER (PARTITION BY correlation_id ORDER BY created_at DESC, event_id DESC) AS rn FROM feedback) f
  ON i.correlation_id = f.correlation_id AND rn = 1 WHERE {SINCE})"""


def sort_keys(name: str) -> list:
    """The six named orders, each ended by the unique id; places of nulls are stated."""
    keys = {
        "newest": [F.desc("created_at")], "oldest": [F.asc("created_at")], "lowest_confidence": [F.asc("confidence")], "highest_confidence": [F.desc("confidence")],
        "helpful_first": [F.desc_nulls_last("rating")], "not_helpful_first": [F.asc_nulls_last("rating")],
    }
    if name not in keys:
        raise ValueError(f"unknown order {name}")
    return [*keys[name], F.asc("correlation_id")]


@register(
    "interaction_page",
    with_views(INTERACTIONS, FEEDBACK, body=f"""SELECT correlation_id, session_id, country, topic, confidence, tokens, rating FROM {_ROWS} t
WHERE lower(topic) LIKE '%topic-1%' OR lower(country) LIKE '%nation_2%' ORDER BY rating DESC NULLS LAST, correlation_id LIMIT 25 OFFSET 25"""),
)
def interaction_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search, helpful answers first."""
    rows = interaction_rows(spark, sf_dir).filter(text_search("topic-1", F.col("topic")) | text_search("nation_2", F.col("country")))
    rows = rows.select("correlation_id", "session_id", "country", "topic", "confidence", "tokens", "rating")
    return rows.orderBy(*sort_keys("helpful_first")).offset(25).limit(25)


@register(
    "page_total",
    with_views(INTERACTIONS, FEEDBACK, body=f"""SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25)) AS BIGINT) AS total_pages,
  count(*) FILTER (WHERE rating > 0) AS helpful, count(*) FILTER (WHERE rating < 0) AS not_helpful, count(*) FILTER (WHERE rating IS NULL) AS unrated FROM {_ROWS} t"""),
)
def page_total(spark: SparkSession, sf_dir: str, size: int = 25) -> DataFrame:
    rating = F.col("rating")
    facets = [F.count_if(feedback_facet(rating, f)).alias(f) for f in ("helpful", "not_helpful", "unrated")]
    return interaction_rows(spark, sf_dir).agg(F.count("*").alias("total"), F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("total_pages"), *facets)


@register(
    "sort_orders",
    with_views(INTERACTIONS, FEEDBACK, body=" UNION ALL ".join(
        f"SELECT '{n}' AS sort, correlation_id, rn FROM (SELECT correlation_id, row_number() OVER (ORDER BY {o}, correlation_id) AS rn FROM {_ROWS} t) WHERE rn <= 5"
        for n, o in {"newest": "created_at DESC", "oldest": "created_at", "lowest_confidence": "confidence", "highest_confidence": "confidence DESC", "helpful_first": "rating DESC NULLS LAST", "not_helpful_first": "rating NULLS LAST"}.items())),
)
def sort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each named order."""
    rows, out = interaction_rows(spark, sf_dir), None
    for name in ("newest", "oldest", "lowest_confidence", "highest_confidence", "helpful_first", "not_helpful_first"):
        first = rows.orderBy(*sort_keys(name)).limit(5)  # five rows; the window below only numbers them
        w = Window.orderBy(*sort_keys(name))
        part = first.select(F.lit(name).alias("sort"), "correlation_id", F.row_number().over(w).cast("long").alias("rn"))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "market_fallback_report",
    with_views(INTERACTIONS, body=f"""SELECT country, round(avg(CASE WHEN fallback THEN 1.0 ELSE 0.0 END), 4) AS fallback_rate, avg(CASE WHEN fallback THEN 1.0 ELSE 0.0 END) >= 0.2 AS alert
FROM interactions WHERE {SINCE} GROUP BY country"""),
)
def market_fallback_report(spark: SparkSession, sf_dir: str, threshold: float = 0.2) -> DataFrame:
    """The rate that a due report compares with its threshold."""
    rate = F.avg(F.col("fallback").cast("double"))
    return recent(spark, sf_dir).groupBy("country").agg(F.round(rate, 4).alias("fallback_rate"), (rate >= threshold).alias("alert"))


@register(
    "stage_timings",
    """SELECT event_type AS stage, count(*) AS n, round(sum(value), 2) AS total_ms, round(avg(value), 4) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms,
  round(count(*) FILTER (WHERE value < 100) / count(*), 4) AS success_ratio, arg_max(value, ts) AS last_ms FROM events GROUP BY event_type""",
)
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, timings, a ratio gauge and the last value of each stage."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(
        F.count("*").alias("n"), F.round(F.sum(v), 2).alias("total_ms"), F.round(F.avg(v), 4).alias("avg_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"),
        F.round(F.count_if(v < 100) / F.count("*"), 4).alias("success_ratio"), F.max_by("value", "ts").alias("last_ms"),
    )


@register(
    "operations_status",
    """SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS active_jobs, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed_jobs, strftime(max(o_orderdate), '%Y-%m-%d') AS last_update,
  count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderdate < TIMESTAMP '2001-07-31') AS expiring,
  CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'error' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'warning' ELSE 'healthy' END AS status FROM orders""",
)
def operations_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job counts, newest change, documents about to expire, and the worst status."""
    s, d = F.col("o_orderstatus"), F.col("o_orderdate")
    failed, active = F.count_if(s == "F"), F.count_if(s == "P")
    return table(spark, sf_dir, "orders").agg(
        active.alias("active_jobs"), failed.alias("failed_jobs"), F.date_format(F.max(d), "yyyy-MM-dd").alias("last_update"),
        F.count_if(time_window(d, AS_OF, start=dt.datetime(2001, 7, 1), end=dt.datetime(2001, 7, 31))).alias("expiring"),
        F.when(failed > 0, "error").when(active > 0, "warning").otherwise("healthy").alias("status"),
    )


@register(
    "market_readiness",
    """SELECT n_name AS country, r_name AS region, coalesce(agents, 0) AS agents, coalesce(clients, 0) AS clients,
  CASE WHEN coalesce(clients, 0) = 0 THEN 'not_configured' WHEN coalesce(agents, 0) = 0 THEN 'warning' ELSE 'pass' END AS readiness
FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS agents FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON n_nationkey = s_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS clients FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey""",
)
def market_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-way lookup of small sides, and the worst of the required checks."""
    agents = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("agents"))
    clients = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("clients"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.join(agents, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(clients, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    a, c = F.coalesce("agents", F.lit(0)), F.coalesce("clients", F.lit(0))
    return rows.select(
        F.col("n_name").alias("country"), F.col("r_name").alias("region"), a.alias("agents"), c.alias("clients"),
        F.when(c == 0, "not_configured").when(a == 0, "warning").otherwise("pass").alias("readiness"),
    )
