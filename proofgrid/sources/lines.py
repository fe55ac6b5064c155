"""Reading JSON lines without losing track of what is broken: every line with its file and number, good rows and damage apart.

Lines are numbered by Spark: within a split of a file rows follow each other, splits are counted, and a split's lines start
after those of the splits before it; so no file is read in one task. Damage is a blank line, text that isn't JSON, JSON that
isn't an object, a missing or null key, or a value that doesn't fit its column's type.

Nulls, ties and odd input: a null or absent field that isn't a key is null; fields that the schema doesn't name are passed
over; of records with equal keys the last in order of file and line counts; an empty folder of files gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held

# Why a line is no record, the first that holds.
REASONS = ("blank", "not_json", "not_an_object", "no_key", "wrong_type")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and line of all text files of a path."""
    rows = held(spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line")))
    splits = rows.groupBy("file", "split").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", "first", before.alias("before"))  # a row for each split
    return rows.join(starts, ["file", "split"]).select("file", (F.col("k") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")


def checked_records(lines: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """file, line_no, line, record (a struct of schema, null if damaged) and reason (null for a record) of every line."""
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    kind = F.schema_of_variant("v")
    present = [F.try_variant_get("v", f"$['{f.name}']", "variant").isNotNull() & (F.try_variant_get("v", f"$['{f.name}']", "string").isNotNull()) for f in schema.fields]
    values = {f.name: F.try_variant_get("v", f"$['{f.name}']", f.dataType.simpleString()) for f in schema.fields}
    misfit = F.lit(False)
    for f, there in zip(schema.fields, present, strict=True):
        misfit = misfit | (there & values[f.name].isNull())
    tests = (F.trim(F.coalesce("line", F.lit(""))) == "", F.col("v").isNull(), ~kind.startswith("OBJECT"), F.try_variant_get("v", f"$['{key}']", "string").isNull(), misfit)
    reason = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in zip(REASONS, tests, strict=True)])
    record = F.struct(*[v.alias(n) for n, v in values.items()])
    return parsed.withColumn("reason", reason).select("file", "line_no", "line", F.when(F.col("reason").isNull(), record).alias("record"), "reason")


def last_records(checked: DataFrame, key: str) -> DataFrame:
    """The fields, file and line_no of the last record of each key."""
    newest = checked.where("reason IS NULL").groupBy(F.col("record")[key].alias("k")).agg(F.max_by(F.struct("record", "file", "line_no"), F.struct("file", "line_no")).alias("last"))
    return newest.select("last.record.*", "last.file", "last.line_no")


def losses(checked: DataFrame) -> DataFrame:
    """file, reason, n, first_line, last_line of damaged lines."""
    return checked.where("reason IS NOT NULL").groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
