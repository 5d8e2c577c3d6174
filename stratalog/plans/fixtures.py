"""Changelogs derived from the star-schema tables, in Spark and as SQL subqueries of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.segments import even_segments
from stratalog.sources.tables import table


def events_log(spark: SparkSession, d: str) -> DataFrame:
    """namespace = event type, key = user, a delete at every seventh event, ts = event_id."""
    value = F.when(F.col("event_id") % 7 != 0, F.encode("props", "UTF-8"))
    return table(spark, d, "events").select(F.col("event_type").alias("namespace"), F.encode(F.format_string("user_%06d", "user_id"), "UTF-8").alias("key"), value.alias("value"), F.col("event_id").alias("ts"))


EVENTS = "(select event_type as namespace, encode(printf('user_%06d', user_id)) as key, case when event_id % 7 <> 0 then encode(props) end as value, event_id as ts from events)"


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    """namespace = order status, key = order number, no overwrites."""
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("namespace"), F.encode(F.format_string("%012d", "o_orderkey"), "UTF-8").alias("key"), F.encode("o_orderpriority", "UTF-8").alias("value"), (F.col("o_orderkey") + 1).alias("ts"))


ORDERS = "(select o_orderstatus as namespace, encode(printf('%012d', o_orderkey)) as key, encode(o_orderpriority) as value, o_orderkey + 1 as ts from orders)"


def document_log(spark: SparkSession, d: str) -> DataFrame:
    """namespace = language, key = document, large values."""
    return table(spark, d, "documents").select(F.col("lang").alias("namespace"), F.encode(F.format_string("%012d", "doc_id"), "UTF-8").alias("key"), F.encode("text", "UTF-8").alias("value"), F.col("doc_id").alias("ts"))


def segmented(spark: SparkSession, d: str) -> DataFrame:
    """events_log in segments of 1,250 consecutive writes, from 0."""
    return events_log(spark, d).withColumn("segment", F.expr("ts div 1250"))


SEGMENTED = f"(select *, ts // 1250 as segment from {EVENTS})"


def eighths(spark: SparkSession, d: str) -> DataFrame:
    """events_log in eight segments of consecutive writes, from 0, which grow with the table (F3 of FIXTURES.md)."""
    return even_segments(events_log(spark, d), 8)


EIGHTHS = f"(select *, ntile(8) over (order by ts) - 1 as segment from {EVENTS})"


def op_log(spark: SparkSession, d: str) -> DataFrame:
    """Operations by event type: error deletes, click and view read, others put; every eleventh fails."""
    t = F.col("event_type")
    op = F.when(t == "error", "delete").when(t.isin("click", "view"), "get").otherwise("put")
    return table(spark, d, "events").select("event_id", "user_id", op.alias("op"), (F.col("event_id") % 11 != 0).alias("ok"))


OPS = "(select event_id, user_id, case when event_type = 'error' then 'delete' when event_type in ('click', 'view') then 'get' else 'put' end as op, event_id % 11 <> 0 as ok from events)"


def newest(log: str) -> str:
    """SQL of the newest entry of each key."""
    return f"(select namespace, key, value, ts from {log} qualify row_number() over (partition by namespace, key order by ts desc) = 1)"
