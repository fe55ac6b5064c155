"""Document fingerprints by one-permutation MinHash of five-word shingles.

Each shingle is hashed once; the top bits of the hash name a bin, and a bin keeps its smallest hash. Empty bins copy a
filled one by optimal densification (a chain of hashes of the bin's number that depends on no data), and of each bin the
low bits are stored. Two fingerprints agree in a bin by chance with probability 2**-bits, which the likeness corrects.

Nulls, ties and odd input: a null text is empty; a text without words has an empty fingerprint, which is like another
empty one (1) and unlike any other (0); null ids come before all others, equal ids in order of their texts; of one
document alone the next is itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, shingle_hashes, text_or_empty, word_hashes

BINS, BITS, SHINGLE = 512, 4, 5
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NO_ID = -(1 << 63)

_chain: list[np.ndarray] = []


def chained(attempt: int, bins: int) -> np.ndarray:
    """For each bin the one to look into at this attempt."""
    while len(_chain) <= attempt:
        seed = np.uint64(len(_chain) + 1) * np.uint64(1 << 32)
        _chain.append(mix(np.arange(1, 4097, dtype=np.uint64) + seed))
    return (_chain[attempt][:bins] % np.uint64(bins)).astype(np.int64)


def bin_minima(shingles: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """The densified signature: one hash a bin; None without shingles."""
    if not len(shingles):
        return None
    hashes = np.sort(shingles)
    own = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], own[1:] != own[:-1]])
    filled = np.zeros(bins, bool)
    filled[own[first]] = True
    out = np.zeros(bins, np.uint64)
    out[own[first]] = hashes[first]
    empty, attempt = np.flatnonzero(~filled), 0
    if len(empty) == bins - 1:
        out[:] = hashes[0]
        return out
    while len(empty):
        there = chained(attempt, bins)[empty]
        good = filled[there]
        out[empty[good]] = out[there[good]]
        empty, attempt = empty[~good], attempt + 1
    return out


def fingerprint(text: str, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> str:
    """Base64 of the packed low-order bits; empty for a text without words."""
    minima = bin_minima(shingle_hashes(word_hashes(text), k), bins)
    if minima is None:
        return ""
    # hashed anew with the bin's number, so that bins filled with one hash differ from those of another text one by one
    low = (mix(minima ^ mix(np.arange(1, bins + 1, dtype=np.uint64))) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return base64.b64encode(np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]).tobytes()).decode()


def likeness(a: str, b: str, bins: int = BINS, bits: int = BITS) -> float:
    """The estimated Jaccard similarity of two shingle sets, corrected for bits that agree by chance."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(base64.b64decode(s), np.uint8) for s in (a, b))
    unlike = np.unpackbits(x ^ y).reshape(bins, bits).any(axis=1).mean()
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (1 - unlike - chance) / (1 - chance))))


def with_next(docs: DataFrame, buckets_per_partition: int = 8) -> DataFrame:
    """key, doc_id, text, bucket, helper: rows by range of doc_id; each bucket ends with a copy of the next one's first row.

    Of the ids only the smallest of each bucket come to the driver, a number set by the shuffle partitions.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), text_or_empty().alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("key").repartitionByRange(partitions * buckets_per_partition, "key")
    bounds = np.array(sorted(r["least"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.min("key").alias("least")).collect()), np.int64)

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(bounds, key.to_numpy(), "right") - 1).astype(np.int32))

    @F.pandas_udf("boolean")
    def opens(key: pd.Series) -> pd.Series:
        values = key.to_numpy()
        at = np.searchsorted(bounds, values, "right") - 1
        return pd.Series(bounds[at] == values)

    if not len(bounds):
        return rows.limit(0).select("*", F.lit(0).alias("bucket"), F.lit(False).alias("helper"))
    placed = rows.withColumn("bucket", bucket_of("key")).withColumn("opens", opens("key"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("helper"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(bounds))).cast("int").alias("bucket"), F.lit(True).alias("helper"))
    both = placed.withColumn("to", F.explode(F.when(F.col("opens"), F.array(own, before)).otherwise(F.array(own))))
    out = both.select("doc_id", "key", "text", "to.bucket", "to.helper")
    return out.repartition(partitions, "bucket").sortWithinPartitions("bucket", "helper", "key", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """RESULT for every document: its fingerprint, its edited text's, and the likeness to that and to the next document's."""

    def run(batches):
        import pyarrow as pa

        fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
        last, out = None, []
        for rows in chunks(batches):
            for row in rows:
                mark = fingerprint(row["text"])
                if last is not None and last[0]["bucket"] == row["bucket"]:
                    own, own_mark = last
                    other = edited(own["text"], row["text"])
                    other_mark = fingerprint(other)
                    out.append((own["doc_id"], len(own["text"]), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, other_mark, likeness(own_mark, other_mark), likeness(own_mark, mark)))
                last = None if row["helper"] else (row, mark)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])
            out = []

    return with_next(docs).mapInArrow(run, RESULT)
