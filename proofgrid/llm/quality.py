"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters, digits and non-ASCII bytes; runs of other signs are words of their own. The features of a text
are its words and pairs of neighbouring words, hashed to 2**18 places, with damped counts scaled to unit length. Labelled
rows are split over shards; in each round every shard goes on from the common state by per-coordinate FTRL-proximal
updates, and what the shards add to the state goes with that state (vectors of fixed size) to the shared folder, where the
next round reads it. The driver sees the final weights alone (1 MB, whatever the input) and broadcasts them; scores are sparse dot
products with them.

The model is fitted on a bounded sample: at most SAMPLE labelled rows, those with the smallest hash of their id.
Nulls, ties and odd input: a null text is empty, and an empty text has the bias alone; null labels and null ids teach
nothing; an id labelled twice counts once with the lower label; without labels every score is 0.5; other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chunks, filesystem, mix, run_hashes, scratch, stored, text_or_empty

BUCKETS, SAMPLE, SHARDS, ROUNDS = 1 << 18, 20_000, 4, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0005, 0.0005
THRESHOLD = 0.3

_KIND = np.where(SPACE, 0, 2).astype(np.int8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def ngram_hashes(text: str, piece: int = 1 << 20):
    """Hashes of all words and of all pairs of neighbouring words, in pieces of the text."""
    raw, at, before = text.encode("utf-8", "surrogatepass"), 0, None
    while at < len(raw):
        data = np.frombuffer(raw, np.uint8, min(piece, len(raw) - at), at)
        kind = _KIND[data]
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        if at + len(data) < len(raw) and len(change):  # the last run may go on
            data, kind, change = data[: change[-1]], kind[: change[-1]], change[:-1]
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(data)]])
        words = kind[starts] > 0
        own = run_hashes(data, starts[words], ends[words])
        line = own if before is None else np.concatenate([[before], own])
        yield own
        if len(line) > 1:
            yield mix(line[:-1] * np.uint64(3) + line[1:])
        if len(own):
            before = own[-1]
        at += len(data)


def features(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; place 0 is the bias."""
    parts = [(h % np.uint64(buckets - 1)).astype(np.int32) + 1 for h in ngram_hashes(text)]
    places = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    if len(places) == 0:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    at, counts = np.unique(places, return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt((values**2).sum())
    return np.concatenate([[0], at]).astype(np.int32), np.concatenate([[1.0], values]).astype(np.float32)


class Ftrl:
    """Per-coordinate FTRL-proximal state: z and n, from which the weights follow."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z.copy(), n.copy()

    @staticmethod
    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, label: int, at: np.ndarray, x: np.ndarray) -> None:
        z, n = self.z[at], self.n[at]
        w = self.weights(z, n)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def summed(folder: str, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The common state after some rounds, from the last round's rows in the shared folder: its shards' common state and what each added."""
    import pyarrow.dataset as ds

    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if rounds:
        fs, path = filesystem(f"{folder}/{rounds - 1}")
        rows = ds.dataset(path, filesystem=fs, format="parquet").to_table(["z", "n", "before_z", "before_n"]).to_pylist()
        for k, r in enumerate(sorted(rows, key=lambda r: r["z"])):
            if k == 0:
                z, n = np.frombuffer(r["before_z"]), np.frombuffer(r["before_n"])
            z, n = z + np.frombuffer(r["z"], np.float32), n + np.frombuffer(r["n"], np.float32)
    return z, n


def held_out(doc_id) -> F.Column:
    """The rows that no label is learnt from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (float32) learnt from at most `sample` labelled rows that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.where(~held_out("doc_id"))
    # hashes are even, so this keeps a little more than the sample and no task has to order all labels
    share = min(1.0, (1.1 * sample + 1000) / max(1, known.count()))
    lowest = known.where(F.xxhash64("doc_id") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))))
    chosen = lowest.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def to_features(batches):
        import pyarrow as pa

        for some in chunks(batches):
            found = [features(r["text"]) for r in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in some], pa.int64()), pa.array([int(r["label"]) for r in some], pa.int32()), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())],
                ["doc_id", "label", "places", "values"],
            )

    learnt = stored(rows.mapInArrow(to_features, "doc_id long, label int, places binary, values binary"), "quality-features")
    order = F.xxhash64(F.lit("order"), "doc_id")
    learnt = learnt.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", order, "doc_id")
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "quality-rounds")
    for k in range(rounds):

        def one_round(batches, k=k):
            import pyarrow as pa

            common, mine = None, {}
            for some in chunks(batches):
                common = summed(folder, k) if common is None else common
                for r in some:
                    mine.setdefault(r["shard"], Ftrl(*common)).update(r["label"], np.frombuffer(r["places"], np.int32), np.frombuffer(r["values"], np.float32))
            added = [((f.z - common[0]).astype(np.float32).tobytes(), (f.n - common[1]).astype(np.float32).tobytes(), common[0].tobytes(), common[1].tobytes()) for _, f in sorted(mine.items())]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in added], pa.binary()) for j in range(4)], ["z", "n", "before_z", "before_n"])

        learnt.mapInArrow(one_round, "z binary, n binary, before_z binary, before_n binary").write.parquet(f"{folder}/{k}")

    def end(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([Ftrl.weights(*summed(folder, rounds)).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    return np.frombuffer(spark.range(1, numPartitions=1).mapInArrow(end, "weights binary").first()[0], np.float32)


def score_column(spark, weights: np.ndarray):
    """A column function: the probability that a text has label 1."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            at, x = features(text or "")
            out[k] = w[at] @ x
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    score = score_column(docs.sparkSession, train(docs, labels))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(text_or_empty()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least `threshold`, with their columns."""
    score = score_column(docs.sparkSession, train(labelled_docs, labels))
    return docs.where(score(text_or_empty()) >= threshold)
