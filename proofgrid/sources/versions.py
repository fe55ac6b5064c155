"""A table in versions: written aside, counted, and published by one manifest file that no second writer can make.

A version's rows go to a folder of their own name; its manifest, made only if it isn't there yet, says where they are, how
many, and who made them. Readers see versions that have a manifest, whole; what a failed writer leaves has none. The
manifest's making has to be exclusive in the file system, as in HDFS and local files.

Nulls, ties and odd input: an empty table is a version of no rows; a root without versions raises LookupError.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionTaken(RuntimeError):
    """Another writer has published that version."""


def _manifest(spark: SparkSession, root: str, version: int):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifests/{version:09d}.json")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """What the manifests of a root say, oldest first: version, folder, n_rows, counts, note, at."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifests")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not files.listStatus(folder):
        return []
    rows = spark.read.text(f"{root}/_manifests", wholetext=True).collect()  # one row for each version
    return sorted((json.loads(r["value"]) for r in rows if r["value"].strip()), key=lambda m: m["version"])


def publish(rows: DataFrame, root: str, version: int, count_by: str | None = None, note: str = "") -> dict:
    """Writes rows as a version and publishes it; raises VersionTaken, and leaves the other's version as it is, if there is one.

    count_by names a column of few values, whose counts the manifest holds.
    """
    spark = rows.sparkSession
    files, path = _manifest(spark, root, version)
    if files.exists(path):
        raise VersionTaken(f"version {version} of {root} is there")
    folder = f"{root}/data-{version:09d}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    counts = {str(k): n for k, n in written.groupBy(F.col(count_by).cast("string")).count().collect()} if count_by else {}
    made = {"version": version, "folder": folder.rpartition("/")[2], "n_rows": sum(counts.values()) if count_by else written.count(), "counts": dict(sorted(counts.items())), "note": note, "at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    text = json.dumps(made, sort_keys=True, ensure_ascii=True)
    try:
        out = files.create(path, False)
    except Exception as taken:
        raise VersionTaken(f"version {version} of {root} is there") from taken
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return made


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest whole one by default; raises if there are not as many as its manifest says."""
    found = [m for m in manifests(spark, root) if version is None or m["version"] == version]
    if not found:
        raise LookupError(f"no version {'' if version is None else version} in {root}")
    rows = spark.read.parquet(f"{root}/{found[-1]['folder']}")
    if (n := rows.count()) != found[-1]["n_rows"]:
        raise RuntimeError(f"version {found[-1]['version']} has {n} rows, not {found[-1]['n_rows']}")
    return rows
