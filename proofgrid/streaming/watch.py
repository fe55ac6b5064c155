"""Watch desk as a structured stream: matching items, one alert for each rule and story, outages and late data.

Feeds are file streams run with availableNow, so a run takes what has arrived and stops; the table of alerts holds the keys
that were seen, and a second run alerts only what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path as folder  # noqa: F401


def feed(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of a directory as a stream of its files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{directory}/{name}.parquet*")


def matched(items: DataFrame, rules: list[dict], title: Column, language: Column) -> DataFrame:
    """items once for each rule that they match: the title has the rule's keyword (case aside), and the language is one of the rule's, if it names any and the item has one."""
    hit = [
        F.when(F.lower(title).contains(r["keyword"].lower().strip('"')) & (language.isNull() | F.lit(not r.get("languages")) | language.isin(*(r.get("languages") or [""]))), F.lit(r["rule_id"])) for r in rules
    ]
    return items.withColumn("rule_id", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())))


def alerts(items: DataFrame, rule_id: str, matches: Column, story_key: Column) -> DataFrame:
    """rule_id, story_key, alert_id of each item that a rule matches."""
    found = items.where(matches).select(F.lit(rule_id).alias("rule_id"), story_key.alias("story_key"))
    digest = F.left(F.sha2(F.concat("rule_id", "story_key"), 256), F.lit(10))
    return found.withColumn("alert_id", F.concat(F.lit("alrt-"), digest))


def corroboration(publishers: Column) -> Column:
    return F.when(publishers <= 1, "single-source story").otherwise(F.concat(publishers.cast("string"), F.lit(" independent publishers")))


def run(stream: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("rule_id", "story_key")) -> DataFrame:
    """Runs a stream over what is there and returns all alerts, each of its keys once.

    What was alerted is the table at `out`, one folder a batch, so no state grows in memory; a batch that is done again
    replaces its own folder.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{out}/batch=-1")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    read = lambda: spark.read.schema(schema).parquet(out)

    def add(batch: DataFrame, number: int) -> None:
        seen = read().where(F.col("batch") < number).select(*keys).distinct()
        batch.dropDuplicates(list(keys)).join(seen, list(keys), "left_anti").select(*stream.columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read().select(*stream.columns)
