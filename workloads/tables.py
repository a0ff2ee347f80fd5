"""Survey-shaped views of the test tables, in Spark and as SQL text.

The tables hold no NULLs and no multi-select texts, so both are derived from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing values and types."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        "props",
    )


ANSWERS = """(SELECT event_id, user_id,
  CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value, props FROM events)"""


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day: the event types as one multi-select text, the value total.

    A user's day has at most five distinct types.
    """
    events = table(spark, sf_dir, "events")
    return (
        events.groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            F.array_join(F.sort_array(F.collect_set("event_type")), ";").alias("types"),
            F.round(F.sum("value"), 2).alias("total"),
        )
        .withColumn("log_total", F.log1p("total"))
    )


USER_DAYS = """(SELECT user_id, CAST(ts AS DATE) AS day,
  array_to_string(list_sort(list(DISTINCT event_type)), ';') AS types,
  round(sum(value), 2) AS total, ln(1 + round(sum(value), 2)) AS log_total
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""


def tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a multi-select text holding repeats, blanks, rare tokens and NULLs."""
    events = table(spark, sf_dir, "events")
    text = F.concat_ws(
        ";",
        F.col("event_type"),
        F.concat(F.lit(" group"), (F.col("user_id") % 61).cast("string")),
        F.when(F.col("event_id") % 5 == 0, F.col("event_type")),
        F.when(F.col("event_id") % 13 == 0, F.lit("  ")),
        F.concat(F.lit("user"), F.col("user_id").cast("string")),
    )
    return events.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, None)
        .when(F.col("event_id") % 17 == 0, F.lit(" "))
        .when(F.col("event_id") % 19 == 0, F.lit(";;"))
        .otherwise(text)
        .alias("tags"),
    )


TAGGED_EVENTS = """(SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL
  WHEN event_id % 17 = 0 THEN ' ' WHEN event_id % 19 = 0 THEN ';;'
  ELSE concat_ws(';', event_type, ' group' || CAST(user_id % 61 AS VARCHAR),
    CASE WHEN event_id % 5 = 0 THEN event_type END, CASE WHEN event_id % 13 = 0 THEN '  ' END,
    'user' || CAST(user_id AS VARCHAR)) END AS tags FROM events)"""

# Distinct tokens of tagged_events as (event_id, token).
TAG_TOKENS = f"""(SELECT DISTINCT event_id, token FROM (
  SELECT event_id, '__MISSING__' AS token FROM {TAGGED_EVENTS} WHERE tags IS NULL OR trim(tags) = ''
  UNION ALL
  SELECT event_id, trim(part) AS token FROM (
    SELECT event_id, unnest(string_split(tags, ';')) AS part FROM {TAGGED_EVENTS}
    WHERE tags IS NOT NULL AND trim(tags) <> '') WHERE trim(part) <> ''))"""


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the priority as an ordered score; one label counts as no answer."""
    from censusloom.functions.scalars import label_score

    orders = table(spark, sf_dir, "orders")
    return orders.withColumn("priority_order", label_score(F.col("o_orderpriority"), PRIORITY_SCORES))


PRIORITY_SCORES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}
PRIORITY_LABELS = {score: label for label, score in PRIORITY_SCORES.items()}
SCORED_ORDERS = """(SELECT *, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
  THEN CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS priority_order FROM orders)"""


def experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as respondents whose years are partly given as boundary texts."""
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    return part.select(
        "p_partkey",
        F.when(size == 1, "Less than 1 year")
        .when(size == 50, "More than 50 years")
        .when(key % 23 == 0, "no idea")
        .when(key % 29 == 0, None)
        .otherwise(size.cast("string"))
        .alias("years_text"),
        (key % 30).cast("string").alias("professional_text"),
        F.when(key % 9 != 0, (key % 45).cast("double")).alias("work_years"),
        F.when(key % 31 == 0, 0.0).otherwise(size.cast("double")).alias("total_years"),
    )


EXPERIENCE = """(SELECT p_partkey, CASE WHEN p_size = 1 THEN 'Less than 1 year'
  WHEN p_size = 50 THEN 'More than 50 years' WHEN p_partkey % 23 = 0 THEN 'no idea'
  WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS years_text,
  CAST(p_partkey % 30 AS VARCHAR) AS professional_text,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 45 AS DOUBLE) END AS work_years,
  CASE WHEN p_partkey % 31 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS total_years FROM part)"""
