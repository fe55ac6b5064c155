"""Queries of feeds as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ..sources.tables import read
from ..streaming import outages


def feed_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of users' events as outages of their feeds: a stream of three deliveries, stopped after the second and started anew for the third, whose events are the earliest."""
    polls = read(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("feed"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("error"))
    low, high = polls.agg(F.percentile_approx(F.col("at").cast("double"), [1 / 3, 2 / 3])).first()[0] or (0.0, 0.0)
    polls = polls.withColumn("part", F.lit(1) + (F.col("at").cast("double") > low).cast("int") + (F.col("at").cast("double") > high).cast("int"))
    source, out, checkpoint = (shared_path(spark, f"outages-{x}") for x in ("in", "out", "state"))
    many = spark.sparkContext.defaultParallelism  # files of a delivery
    stream = lambda: outages.run(outages.outage_log(spark.readStream.schema(polls.drop("part").schema).option("maxFilesPerTrigger", many).parquet(f"{source}/*"), late="1000 days"), out, checkpoint)
    for name, part in (("a", 2), ("b", 3)):
        polls.where(F.col("part") == part).drop("part").repartition(many).write.parquet(f"{source}/{name}")
    stream()
    polls.where("part = 1").drop("part").repartition(many).write.parquet(f"{source}/c")
    return stream().where("NOT closed").select("feed", "n_outages", "n_kept", "errors", F.date_format("last_at", "yyyy-MM-dd").alias("last_day"), F.date_format("oldest_kept", "yyyy-MM-dd").alias("oldest_day"))


QUERIES = {"feed_outages": feed_outages}
ORACLES = {
    "feed_outages": """WITH e AS (SELECT 'user:' || user_id AS feed, ts, 'e' || lpad(event_id::VARCHAR, 12, '0') AS error, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE event_type = 'error')
        SELECT feed, count(*) AS n_outages, least(count(*), 50)::INTEGER AS n_kept, string_agg(error, ',' ORDER BY back DESC) FILTER (back <= 3) AS errors, strftime(max(ts), '%Y-%m-%d') AS last_day,
               strftime(min(ts) FILTER (back <= 50), '%Y-%m-%d') AS oldest_day FROM e GROUP BY feed""",
}
