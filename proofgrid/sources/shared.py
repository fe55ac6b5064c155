"""The folder that the whole cluster shares, for checkpoints and tables that one job writes and another reads."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a local session gets a folder of its own; a cluster has to name one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Jobs that store their result in the shared folder need their shuffle files no longer than that."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def held(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder; the shuffle files that made it go."""
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        # a plan keeps the setting it was made under
        return df.select("*").checkpoint()


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, it survives the loss of executors, and the shuffle files that made it go."""
    path = shared_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tabled(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a compressed table: several times smaller than what held() writes."""
    return stored(df, "table", "zstd")
