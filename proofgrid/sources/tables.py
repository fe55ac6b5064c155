"""Readers and sinks: Parquet tables, keep-last JSON lines, content-addressed evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str, order: str) -> DataFrame:
    """JSON lines with blank and corrupt lines skipped; of records with equal keys the last by `order` counts."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED").where(F.col(key).isNotNull())
    return keep_last(rows, [key], order)


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, that with the greatest `order`."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("row"))
    return newest.select("row.*")


def append_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON record a line, added to what is there."""
    rows.write.mode("append").json(path)


def evidence_registry(files: DataFrame) -> DataFrame:
    """Registry rows of binaryFile rows: sha256, size, and the first path with the same bytes as storage key."""
    rows = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    first = rows.groupBy("sha256").agg(F.min("path").alias("storage_key"))
    return rows.join(first, "sha256").select("path", "sha256", F.col("length").alias("size_bytes"), "storage_key", (F.col("path") == F.col("storage_key")).alias("is_first"))


def verified(evidence: DataFrame) -> DataFrame:
    """Rows with content and sha256, and whether the bytes still have that hash."""
    return evidence.withColumn("intact", F.sha2("content", 256) == F.col("sha256"))


def paragraphs(lines: DataFrame, most_lines: int = 50) -> DataFrame:
    """doc_id, line_no, line -> one row a paragraph: blank lines end it, and so do most_lines lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    filled = lines.withColumn("blank", F.trim("line") == "").withColumn("block", F.sum(F.col("blank").cast("int")).over(order)).where(~F.col("blank"))
    inside = Window.partitionBy("doc_id", "block").orderBy("line_no")
    part = F.floor((F.row_number().over(inside) - 1) / most_lines)
    return (
        filled.withColumn("part", part)
        .groupBy("doc_id", "block", "part")
        .agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
        .drop("block", "part")
    )


def key_values(lines: DataFrame) -> DataFrame:
    """INI and env lines: doc_id, line_no, line -> section, key, value; sections carry forward, quotes go."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    section = F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1), F.lit(""))
    pair = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.\-]*)\s*[=:]\s*(.*?)\s*$"
    carried = lines.withColumn("section", F.last(section, ignorenulls=True).over(order))
    value = F.regexp_replace(F.regexp_extract("line", pair, 2), r"""^(["'])(.*)\1$""", "$2")
    return carried.where(F.col("line").rlike(pair) & ~F.col("line").rlike(r"^\s*[#;]")).select("doc_id", "line_no", F.coalesce("section", F.lit("")).alias("section"), F.regexp_extract("line", pair, 1).alias("key"), value.alias("value"))


def stix_objects(bundles: DataFrame) -> DataFrame:
    """JSON text of STIX bundles (column value) -> one row an object: stix_id, type, name, external_id, revoked, deprecated."""
    reference = "struct<source_name:string,external_id:string>"
    item = f"struct<id:string,type:string,name:string,revoked:boolean,x_mitre_deprecated:boolean,external_references:array<{reference}>>"
    parsed = bundles.select(F.explode(F.from_json("value", f"struct<objects:array<{item}>>")["objects"]).alias("o"))
    external = F.get(F.filter("o.external_references", lambda r: r["source_name"].startswith("mitre")), 0)["external_id"]
    kind = (
        F.when((F.col("o.type") == "attack-pattern") & external.contains("."), "subtechnique").when(F.col("o.type") == "attack-pattern", "technique").when(F.col("o.type") == "x-mitre-tactic", "tactic")
        .when(F.col("o.type").isin("malware", "tool"), "software").when(F.col("o.type") == "intrusion-set", "group").when(F.col("o.type") == "course-of-action", "mitigation").when(F.col("o.type") == "relationship", "relationship")
    )
    return parsed.select(F.col("o.id").alias("stix_id"), kind.alias("kind"), F.col("o.name").alias("name"), external.alias("external_id"), F.coalesce("o.revoked", F.lit(False)).alias("revoked"), F.coalesce("o.x_mitre_deprecated", F.lit(False)).alias("deprecated"))
