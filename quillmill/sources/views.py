"""Views of the given tables in the roles that conversational analytics needs.

Each view has a DataFrame form and, for the comparison, the same as a SQL common table
expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch: what a Python worker holds of long texts at a time, in several forms, whatever the size of a table.
BATCH_ROWS, BATCH_BYTES = 500, "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; only the columns and rows that a query needs are read, and Python workers get them in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each question: who, where, when, how it was routed, what it cost."""
    events = table(spark, sf_dir, "events")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    routed = kind.isin("click", "purchase")
    return (
        events.join(people, F.col("user_id") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("event_id").alias("correlation_id"),
            F.col("user_id").alias("session_id"),
            F.col("ts").alias("created_at"),
            kind.alias("traffic_source"),
            "country",
            F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("language"),
            F.concat(F.lit("topic-"), (k % 12).cast("string")).alias("topic"),
            (k / 100.0).alias("confidence"),
            (k * 10 + 5).alias("input_tokens"),
            (k * 3).alias("output_tokens"),
            (kind == "error").alias("fallback"),
            (kind == "view").alias("cache_hit"),
            F.when(kind == "click", "fast").when(kind == "purchase", "complex").otherwise("").alias("route_target"),
            F.when(kind == "click", "small-1").when(kind == "purchase", F.concat(F.lit("large-"), (k % 3).cast("string"))).otherwise("").alias("actual_model"),
            F.col("value").alias("latency_ms"),
            F.when(routed, F.array(F.concat(F.lit("r"), (k % 3).cast("string")), F.concat(F.lit("s"), (k % 5).cast("string")))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        )
    )


INTERACTIONS = """interactions AS (
  SELECT x.event_id AS correlation_id, x.user_id AS session_id, x.ts AS created_at, x.event_type AS traffic_source,
         n.n_name AS country,
         CASE n.n_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS language,
         'topic-' || CAST(x.k % 12 AS VARCHAR) AS topic, x.k / 100.0::DOUBLE AS confidence,
         x.k * 10 + 5 AS input_tokens, x.k * 3 AS output_tokens,
         x.event_type = 'error' AS fallback, x.event_type = 'view' AS cache_hit,
         CASE x.event_type WHEN 'click' THEN 'fast' WHEN 'purchase' THEN 'complex' ELSE '' END AS route_target,
         CASE x.event_type WHEN 'click' THEN 'small-1' WHEN 'purchase' THEN 'large-' || CAST(x.k % 3 AS VARCHAR) ELSE '' END AS actual_model,
         x.value AS latency_ms,
         CASE WHEN x.event_type IN ('click', 'purchase') THEN ['r' || CAST(x.k % 3 AS VARCHAR), 's' || CAST(x.k % 5 AS VARCHAR)] ELSE [] END AS reasons
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events) x
  JOIN customer c ON x.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of interactions: 1 helpful, -1 not, 0 neither; some have no interaction."""
    labels = table(spark, sf_dir, "labels")
    rating = F.when(F.col("toxic") == 1, F.lit(-1)).when(F.col("quality") == 1, F.lit(1)).otherwise(F.lit(0))
    at = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("doc_id") % 20000).cast("int"))
    return labels.select(F.col("doc_id").alias("event_id"), (F.col("doc_id") * 11).alias("correlation_id"), rating.alias("rating"), at.alias("created_at"))


FEEDBACK = """feedback AS (
  SELECT doc_id AS event_id, doc_id * 11 AS correlation_id,
         CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS rating,
         TIMESTAMP '2024-01-10 00:00:00' + to_minutes(CAST(doc_id % 20000 AS INTEGER)) AS created_at
  FROM labels)"""


def with_views(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
