"""Helpers shared by the training-data operators: tables, scratch tables, files and hashed words."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import mix, run_hashes
from ..sources.shared import shared_path as scratch
from ..sources.shared import stored

#: ASCII white space; words are the maximal runs of anything else.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def chunks(batches, rows: int = 256):
    """Lists of at most `rows` dicts from Arrow record batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pylist()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def salted(df: DataFrame, salts: int) -> DataFrame:
    """Each row once for every salt; for the side of a join with one row a key."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: str, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash for each white-space separated word of the whole text; long texts are hashed in pieces cut at white space."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + piece)
        if stop < len(raw):
            here = raw[at:stop]
            cut = max(here.rfind(b" "), here.rfind(b"\n"), here.rfind(b"\t"))
            if cut > 0:
                stop = at + cut
            else:
                found = re.compile(rb"[\x20\x09-\x0D]").search(raw, stop)
                stop = found.start() if found else len(raw)
        data = np.frombuffer(raw, np.uint8, stop - at, at)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~SPACE[data]
        step = np.diff(inside)
        out.append(run_hashes(data, np.flatnonzero(step == 1), np.flatnonzero(step == -1)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash for each run of k words in text order; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : i + n]
    return mix(out)
