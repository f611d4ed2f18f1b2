"""Mutations as set operations, retention, generations, sessions and other state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.plans.catalogue import register
from quillmill.sources.views import INTERACTIONS, interactions, table, with_views


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


@register(
    "retention_preview",
    """SELECT 'events' AS source, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-08 00:00:00') AS expired, count(*) FILTER (WHERE NOT ts < TIMESTAMP '2024-01-08 00:00:00') AS kept FROM events
UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '2000-01-01'), count(*) FILTER (WHERE NOT (o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '2000-01-01')) FROM orders
UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01'), count(*) FILTER (WHERE NOT l_shipdate < TIMESTAMP '1996-01-01') FROM lineitem""",
)
def retention_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the windows of each table would delete; a deletion keeps the complement (``kept``)."""
    rules = {
        "events": F.col("ts") < ts("2024-01-08 00:00:00"),
        "orders": F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") < ts("2000-01-01 00:00:00")),
        "lineitem": F.col("l_shipdate") < ts("1996-01-01 00:00:00"),
    }
    out = None
    for name, expired in rules.items():
        part = table(spark, sf_dir, name).agg(F.count_if(expired).alias("expired"), F.count_if(~expired).alias("kept")).select(F.lit(name).alias("source"), "expired", "kept")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "upsert_merge",
    """WITH merged AS (SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS total, min(o_orderdate) AS created_at, count(*) AS writes FROM orders GROUP BY o_custkey)
SELECT o_custkey, first_status, priority, round(total, 2) AS total, strftime(created_at, '%Y-%m-%d') AS created_at, writes FROM merged""",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts in order of time: some columns keep their first value, the others take the last."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min_by("o_orderstatus", at).alias("first_status"), F.max_by("o_orderpriority", at).alias("priority"), F.round(F.max_by("o_totalprice", at), 2).alias("total"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("created_at"), F.count("*").alias("writes"),
    )


@register(
    "insert_ignore",
    """SELECT doc_id, 'existing' AS origin FROM labels UNION ALL
SELECT DISTINCT doc_id, 'inserted' FROM documents d WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New keys are appended, known ones are ignored."""
    have = table(spark, sf_dir, "labels").select("doc_id")
    new = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id").distinct().join(have, "doc_id", "left_anti")
    return have.withColumn("origin", F.lit("existing")).unionByName(new.withColumn("origin", F.lit("inserted")))


@register(
    "conditional_upsert",
    """SELECT c_custkey, CASE WHEN o.n IS NOT NULL AND c_acctbal > 0 THEN 'updated' WHEN o.n IS NOT NULL THEN 'rejected' ELSE 'untouched' END AS outcome,
  CASE WHEN o.n IS NOT NULL AND c_acctbal > 0 THEN 'PREMIUM' ELSE c_mktsegment END AS segment
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) o ON c_custkey = o_custkey""",
)
def conditional_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matched row changes only if its own condition holds; otherwise the write reports that it had no effect."""
    wanted = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_custkey").distinct().withColumn("hit", F.lit(True))
    rows = table(spark, sf_dir, "customer").join(wanted, F.col("c_custkey") == F.col("o_custkey"), "left")
    hit, may = F.col("hit").isNotNull(), F.col("c_acctbal") > 0
    return rows.select(
        "c_custkey", F.when(hit & may, "updated").when(hit, "rejected").otherwise("untouched").alias("outcome"), F.when(hit & may, "PREMIUM").otherwise(F.col("c_mktsegment")).alias("segment")
    )


@register(
    "lease_claims",
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 7 >= 5 THEN 'terminal' WHEN o_orderkey % 3 = 0 AND o_orderdate >= TIMESTAMP '2001-01-01' THEN 'busy' ELSE 'claimed' END AS result,
  o_orderkey % 7 + CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 7 < 5 AND NOT (o_orderkey % 3 = 0 AND o_orderdate >= TIMESTAMP '2001-01-01') THEN 1 ELSE 0 END AS attempts,
  CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 7 >= 5 THEN 'failed' ELSE 'retryable' END AS after_failure FROM orders""",
)
def lease_claims(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """A claim for every job: not if finished, out of attempts, or leased and not expired; else attempts grow by one."""
    attempts = F.col("o_orderkey") % 7
    leased = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderdate") >= ts("2001-01-01 00:00:00"))
    done = F.col("o_orderstatus") == "F"
    result = F.when(done, "completed").when(attempts >= most, "terminal").when(leased, "busy").otherwise("claimed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), result.alias("result"), (attempts + (result == "claimed").cast("int")).alias("attempts"),
        F.when(done, "done").when(attempts >= most, "failed").otherwise("retryable").alias("after_failure"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published generation for each (source, lang) and block of 50 ids of documents."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang", F.expr("doc_id div 50").alias("generation")).agg(F.count("*").alias("sections"))


GENERATIONS = "generations AS (SELECT source, lang, doc_id // 50 AS generation, count(*) AS sections FROM documents GROUP BY ALL)"


@register(
    "generation_switch",
    with_views(GENERATIONS, body="""SELECT source, lang, max(generation) AS active, arg_max(sections, generation) AS sections,
  max(generation) FILTER (WHERE generation < m) AS previous, count(*) FILTER (WHERE generation < m) AS retired
FROM (SELECT *, max(generation) OVER (PARTITION BY source, lang) AS m FROM generations) t GROUP BY source, lang"""),
)
def generation_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers after the newest generation of each identity was published: active, previous and how many were retired."""
    g = generations(spark, sf_dir)
    newest = g.groupBy("source", "lang").agg(F.max("generation").alias("active"), F.max_by("sections", "generation").alias("sections"), (F.count("*") - 1).alias("retired"))
    before = g.join(newest.select("source", "lang", "active"), ["source", "lang"]).filter("generation < active").groupBy("source", "lang").agg(F.max("generation").alias("previous"))
    return newest.join(before, ["source", "lang"], "left").select("source", "lang", "active", "sections", "previous", "retired")


@register(
    "active_rows",
    with_views(GENERATIONS, body="""SELECT lang, count(*) AS rows_active, count(DISTINCT source) AS sources FROM documents d
WHERE EXISTS (SELECT 1 FROM (SELECT source, lang, max(generation) AS g FROM generations GROUP BY ALL) p WHERE p.source = d.source AND p.lang = d.lang AND p.g = d.doc_id // 50) GROUP BY lang"""),
)
def active_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the generation that the pointer names; identities without a pointer have none."""
    pointer = generations(spark, sf_dir).groupBy("source", "lang").agg(F.max("generation").alias("generation"))
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.expr("doc_id div 50").alias("generation"))
    return rows.join(pointer, ["source", "lang", "generation"], "left_semi").groupBy("lang").agg(F.count("*").alias("rows_active"), F.count_distinct("source").alias("sources"))


@register(
    "generation_jobs",
    """SELECT o_orderpriority AS kind, count(*) AS generations, CAST(sum(n) AS BIGINT) AS sections FROM orders JOIN
  (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1""",
)
def generation_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations with the job that made them, but for deleted ones."""
    sections = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    jobs = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return jobs.join(sections, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("generations"), F.sum("n").alias("sections"))


@register(
    "pointer_coverage",
    """WITH p AS (SELECT doc_id, quality AS v FROM labels), r AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS v FROM documents WHERE lang <> 'es')
SELECT 'missing' AS kind, count(*) AS n FROM r WHERE doc_id NOT IN (SELECT doc_id FROM p)
UNION ALL SELECT 'mismatched', count(*) FROM r JOIN p USING (doc_id) WHERE r.v <> p.v
UNION ALL SELECT 'orphaned', count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM r)""",
)
def pointer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without pointer, pointers that differ, and pointers without record, from one full join."""
    p = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("p"))
    r = table(spark, sf_dir, "documents").filter("lang <> 'es'").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("r"))
    kind = F.when(F.col("p").isNull(), "missing").when(F.col("r").isNull(), "orphaned").when(F.col("p") != F.col("r"), "mismatched")
    found = r.join(p, "doc_id", "full").select(kind.alias("kind")).filter("kind is not null").groupBy("kind").agg(F.count("*").alias("m"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in ("missing", "mismatched", "orphaned")])).alias("kind"))
    return names.join(found, "kind", "left").select("kind", F.coalesce("m", F.lit(0)).alias("n"))


@register(
    "metadata_repair",
    """SELECT source, count(DISTINCT lang) AS scopes, CASE WHEN count(DISTINCT lang) > 1 THEN 'conflict' WHEN count(*) FILTER (WHERE lang IS NULL) > 0 THEN 'fill' ELSE 'complete' END AS action,
  CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS fill_value FROM (SELECT source || '/' || CAST(doc_id % 10 AS VARCHAR) AS source, CASE WHEN doc_id % 13 <> 0 THEN lang END AS lang FROM documents) t GROUP BY source""",
)
def metadata_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing is filled if the identity has one value, and is a conflict if it has several."""
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), (F.col("doc_id") % 10).cast("string")).alias("source"), F.when(F.col("doc_id") % 13 != 0, F.col("lang")).alias("lang"))
    scopes = F.count_distinct("lang")
    return d.groupBy("source").agg(
        scopes.alias("scopes"), F.when(scopes > 1, "conflict").when(F.count_if(F.col("lang").isNull()) > 0, "fill").otherwise("complete").alias("action"), F.when(scopes == 1, F.min("lang")).alias("fill_value")
    )


@register(
    "last_n_messages",
    """SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns,
  list(role || ':' || CAST(turn AS VARCHAR) ORDER BY turn) FILTER (WHERE rn <= 4) AS last_messages
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) t GROUP BY conv_id""",
)
def last_n_messages(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    """The newest messages of each conversation, in order; only what ranks among them is gathered."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    mark = F.when(F.col("rn") <= n, F.struct("turn", F.concat("role", F.lit(":"), F.col("turn").cast("string")).alias("m")))
    return c.withColumn("rn", rank).groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.transform(F.sort_array(F.collect_list(mark)), lambda x: x["m"]).alias("last_messages")
    )


@register(
    "replace_source",
    """SELECT lang, count(*) AS rows_after, count(*) FILTER (WHERE fresh) AS fresh FROM (
  SELECT lang, doc_id % 2 = 0 AS fresh FROM documents d WHERE doc_id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.lang = d.lang AND e.source = d.source)) t GROUP BY lang""",
)
def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New copies of a (lang, source) replace its older rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new, old = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 <> 0")
    kept = old.join(new.select("lang", "source").distinct(), ["lang", "source"], "left_anti")
    return new.withColumn("fresh", F.lit(True)).unionByName(kept.withColumn("fresh", F.lit(False)), allowMissingColumns=False).groupBy("lang").agg(F.count("*").alias("rows_after"), F.count_if("fresh").alias("fresh"))


@register(
    "idle_sessions",
    """SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M') AS started, round(epoch(max(ts) - min(ts)) / 60) AS minutes FROM (
  SELECT *, sum(CASE WHEN gap > INTERVAL 6 HOUR OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) a) b GROUP BY user_id, session""",
)
def idle_sessions(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """Sessions end after a pause; a pause of exactly the limit does not end one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    before = F.lag("ts").over(w)
    fresh = before.isNull() | (F.col("ts") > before + F.expr(f"INTERVAL {hours} HOURS"))
    e = e.withColumn("fresh", fresh.cast("int")).withColumn("session", F.sum("fresh").over(w))
    length = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6
    return e.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("started"), F.round(length).alias("minutes"))


@register(
    "alarm_windows",
    """WITH spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29 18:00:00', INTERVAL 6 HOUR)) AS period),
w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS period, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, max(value) AS worst FROM events GROUP BY 1),
m AS (SELECT period, coalesce(total, 0) AS total, CASE WHEN total > 0 THEN 100.0::DOUBLE * failed / total ELSE 0.0 END AS error_rate, worst FROM spine LEFT JOIN w USING (period)),
b AS (SELECT *, error_rate > 22 AS breach, lag(error_rate > 22) OVER (ORDER BY period) AS before FROM m)
SELECT strftime(period, '%Y-%m-%d %H:%M') AS period, total, round(error_rate, 4) AS error_rate, total = 0 AS missing, breach, breach AND coalesce(before, false) AS alarm FROM b""",
)
def alarm_windows(spark: SparkSession, sf_dir: str, threshold: float = 22.0) -> DataFrame:
    """Tumbling periods with those that have no data; an alarm needs two periods in a row."""
    e = table(spark, sf_dir, "events")
    periods = e.groupBy(F.window(F.col("ts"), "6 hours").alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    spine = spark.range(1).select(F.explode(F.sequence(ts("2024-01-01 00:00:00"), ts("2024-01-29 18:00:00"), F.expr("INTERVAL 6 HOURS"))).alias("period"))
    rows = spine.join(periods.select(F.col("w.start").alias("period"), "total", "failed"), "period", "left")
    rate = F.when(F.col("total") > 0, 100.0 * F.col("failed") / F.col("total")).otherwise(0.0)
    rows = rows.select("period", F.coalesce("total", F.lit(0)).alias("total"), rate.alias("rate")).withColumn("breach", F.col("rate") > threshold)
    # one row a period of the alarm's horizon: a bounded series
    before = F.lag("breach", 1, False).over(Window.orderBy("period"))
    return rows.withColumn("alarm", F.col("breach") & before).select(
        F.date_format("period", "yyyy-MM-dd HH:mm").alias("period"), "total", F.round("rate", 4).alias("error_rate"), (F.col("total") == 0).alias("missing"), "breach", "alarm"
    )


@register(
    "ttl_and_eviction",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-30 00:00:00') t WHERE rn <= 8""",
)
def ttl_and_eviction(spark: SparkSession, sf_dir: str, most: int = 8) -> DataFrame:
    """Entries live for a time, and of each owner only the newest stay."""
    live = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").filter(F.col("ts") + F.expr("INTERVAL 7 DAYS") > ts("2024-01-30 00:00:00"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return live.withColumn("rn", rank).filter(F.col("rn") <= most).select("user_id", "event_id")


@register(
    "trace_stages",
    """SELECT user_id, list(event_type ORDER BY rank) AS stages, max(ts) = max(ts) AS has_update FROM (
  SELECT user_id, event_type, max(ts) AS ts, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS rank FROM events GROUP BY user_id, event_type) t GROUP BY user_id""",
)
def trace_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trace holds the newest entry of a stage, in the stages' own order."""
    rank = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "purchase", 4).otherwise(5)
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    stages = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("event_type").alias("s")))), lambda x: x["s"])
    return last.groupBy("user_id").agg(stages.alias("stages"), F.max("ts").isNotNull().alias("has_update"))


@register(
    "permission_lattice",
    """WITH grants AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'manage' WHEN 1 THEN 'publish' WHEN 2 THEN 'stage' ELSE 'view' END AS held FROM customer),
lattice(held, implied) AS (VALUES ('manage','manage'),('manage','publish'),('manage','stage'),('manage','view'),('publish','publish'),('publish','stage'),('publish','view'),('stage','stage'),('stage','view'),('view','view'))
SELECT implied AS permission, count(*) AS holders FROM grants JOIN lattice USING (held) GROUP BY implied""",
)
def permission_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each held permission implies, through a small lattice."""
    implied = {"manage": ("manage", "publish", "stage", "view"), "publish": ("publish", "stage", "view"), "stage": ("stage", "view"), "view": ("view",)}
    held = F.element_at(F.array(*[F.lit(k) for k in implied]), (F.col("c_custkey") % 4 + 1).cast("int"))
    lattice = F.create_map(*[x for k, v in implied.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    return table(spark, sf_dir, "customer").select(F.explode(F.element_at(lattice, held)).alias("permission")).groupBy("permission").agg(F.count("*").alias("holders"))


@register(
    "newest_and_due",
    """SELECT 'newest' AS list, o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 20
UNION ALL SELECT 'due', o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01') WHERE rn <= 20""",
)
def newest_and_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest jobs, and those that are due, oldest first: top-k lists."""
    o, out = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), None
    due = o.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= ts("1996-01-01 00:00:00")))
    for name, rows, key in (("newest", o, F.desc("o_orderdate")), ("due", due, F.asc("o_orderdate"))):
        top = rows.orderBy(key, "o_orderkey").limit(20)
        part = top.select(F.lit(name).alias("list"), "o_orderkey", F.row_number().over(Window.orderBy(key, "o_orderkey")).cast("long").alias("rn"))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "derived_records",
    with_views(INTERACTIONS, body="""SELECT correlation_id, CASE WHEN fallback THEN 'failure' WHEN cache_hit THEN 'general' ELSE topic END AS subject, input_tokens + output_tokens AS tokens,
  list_transform(reasons[1:12], lambda x: left(x, 80)) AS reasons, NOT fallback AND confidence >= 0.47 AND topic <> '' AS cacheable, NOT fallback AND confidence >= 0.75 AND len(reasons) > 0 AS semantic_cacheable,
  CASE WHEN fallback AND confidence < 0.3 THEN 'retrieval' WHEN fallback THEN 'provider' WHEN latency_ms > 200 THEN 'validator' ELSE '' END AS failure_layer FROM interactions"""),
)
def derived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a record gets before it is written: subject, bounded reasons, cacheability, failure layer."""
    c = F.col
    return interactions(spark, sf_dir).select(
        "correlation_id", F.when(c("fallback"), "failure").when(c("cache_hit"), "general").otherwise(c("topic")).alias("subject"), (c("input_tokens") + c("output_tokens")).alias("tokens"),
        F.transform(F.slice("reasons", 1, 12), lambda x: F.substring(x, 1, 80)).alias("reasons"),
        (~c("fallback") & (c("confidence") >= 0.47) & (c("topic") != "")).alias("cacheable"),
        (~c("fallback") & (c("confidence") >= 0.75) & (F.size("reasons") > 0)).alias("semantic_cacheable"),
        F.when(c("fallback") & (c("confidence") < 0.3), "retrieval").when(c("fallback"), "provider").when(c("latency_ms") > 200, "validator").otherwise("").alias("failure_layer"),
    )
