"""Queries over tables that are written and read back: damaged lines, and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lines, versions
from ..sources.shared import shared_path
from ..sources.tables import read

EVENT = "event_id bigint, user_id bigint, event_type string, value double"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines with planted damage, written in order of id and read back with file and line."""
    e = F.col("event_id")
    whole = F.to_json(F.struct("event_id", "user_id", "event_type", F.round("value", 2).alias("value"), F.lit("extra").alias("more")))
    said = (
        F.when(e % 31 == 0, F.lit("  ")).when(e % 29 == 0, F.substring(whole, F.lit(1), F.length(whole) - 3)).when(e % 23 == 0, F.concat(F.lit("["), whole, F.lit("]"))).when(e % 19 == 0, F.replace(whole, F.lit('"event_id"'), F.lit('"id"')))
        .when(e % 17 == 0, F.replace(whole, F.concat(F.lit('"user_id":'), F.col("user_id").cast("string")), F.lit('"user_id":"u-"'))).otherwise(whole)
    )
    folder = shared_path(spark, "event-lines")
    events = read(spark, sf_dir, "events").select("event_id", said.alias("value"))
    events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(folder)
    return lines.checked_records(lines.numbered_lines(spark, folder), spark.createDataFrame([], EVENT).schema, "event_id")


def checked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that are whole, as read back."""
    return lines.last_records(event_lines(spark, sf_dir), "event_id").drop("file", "line_no")


def damaged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was lost: each damaged line and why, and its place counted over all files."""
    found = event_lines(spark, sf_dir)
    return found.where("reason IS NOT NULL").groupBy("reason", "line").agg(F.count(F.lit(1)).alias("n"))


def published_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two versions: all, then those that are still open; what the latest holds, by status and priority."""
    root = shared_path(spark, "orders-versions")
    orders = read(spark, sf_dir, "orders")
    versions.publish(orders, root, 1, "o_orderstatus")
    versions.publish(orders.where("o_orderstatus <> 'F'"), root, 2, "o_orderstatus")
    latest = versions.read_version(spark, root)
    return latest.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {f.__name__: f for f in (checked_events, damaged_events, published_orders)}

_JSON = """'{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || "v" || ',"more":"extra"}'"""
ORACLES = {
    "checked_events": "SELECT event_id, user_id, event_type, round(value, 2) AS value FROM events WHERE event_id % 31 <> 0 AND event_id % 29 <> 0 AND event_id % 23 <> 0 AND event_id % 19 <> 0 AND event_id % 17 <> 0",
    "damaged_events": f"""WITH e AS (SELECT *, round(value, 2)::DOUBLE::VARCHAR AS v FROM events), t AS (SELECT *, {_JSON} AS whole FROM e), d AS (
        SELECT CASE WHEN event_id % 31 = 0 THEN 'blank' WHEN event_id % 29 = 0 THEN 'not_json' WHEN event_id % 23 = 0 THEN 'not_an_object' WHEN event_id % 19 = 0 THEN 'no_key' WHEN event_id % 17 = 0 THEN 'wrong_type' END AS reason,
               CASE WHEN event_id % 31 = 0 THEN '  ' WHEN event_id % 29 = 0 THEN left(whole, length(whole) - 3) WHEN event_id % 23 = 0 THEN '[' || whole || ']' WHEN event_id % 19 = 0 THEN replace(whole, '"event_id"', '"id"')
                    WHEN event_id % 17 = 0 THEN replace(whole, '"user_id":' || user_id, '"user_id":"u-"') END AS line FROM t)
        SELECT reason, line, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY ALL""",
    "published_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL",
}
