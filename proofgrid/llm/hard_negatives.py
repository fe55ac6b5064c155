"""Hard negatives by segment summaries: which rows of other labels score just below an anchor's positives.

A vector is cut into segments; of each its mean and its deviation are stored. For two vectors, the sum over segments of
length * (mean * mean + deviation * deviation) bounds the inner product from above, with minus from below. Coarse segments
come first; what can't reach the scores in question goes, the rest is refined with segments a quarter as long, and only
what is left is scored exactly, in integers.

Anchors (a stated part of the rows) meet all rows in blocks: blocks of rows are dealt to lanes, blocks of anchors come to
every lane, and a task goes through its lane's blocks with the best scores so far as thresholds. So a task holds two blocks
and a lane's rows, each of bounded size, whatever a label's share; rows are blocked in order of label, so that positives
meet blocks of their own label alone. Two passes: each anchor's first positives, then the first negatives of each.

Higher scores come first, ties by smaller id. Nulls, ties and odd input: rows with a null label, a null vector, a null or
non-finite component or no id take no part; rows that repeat an id are rows of their own, but not others to each other, so
an anchor isn't its own positive; a shorter vector counts as if zeros followed; an empty table gives an empty result.
Components and scores have to fit 64-bit integers.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is within these hundredths of its positive's.
LOW, HIGH = 50, 95
ROWS, ANCHORS = 4096, 1024
#: Blocks of rows in a lane at most, where there are more blocks than partitions.
LANE_BLOCKS = 32
#: So many components of pairs are multiplied at once where pairs are scored one by one.
NUMBERS = 1 << 20
#: Numbers of segments, coarse to fine.
SEGMENTS = (1, 4, 16)
_NEVER = -np.inf


@contextmanager
def rows_per_batch(spark: SparkSession, n: int):
    """Rows are blocks here, a few of which fill a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def summaries(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment: rows x 2 x segments."""
    parts = vectors.reshape(len(vectors), segments, -1).astype(np.float64)
    return np.stack([parts.mean(axis=2), parts.std(axis=2)], axis=1)


def coarser(fine: np.ndarray, by: int = 4) -> np.ndarray:
    """Summaries of segments `by` times as long."""
    m, s = (fine[:, k].reshape(len(fine), -1, by) for k in (0, 1))
    mean = m.mean(axis=2)
    return np.stack([mean, np.sqrt((s**2 + (m - mean[:, :, None]) ** 2).mean(axis=2))], axis=1)


class Side:
    """A block of rows: ids, labels, integer vectors, and for each level what bounds scores when multiplied with the other side's."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, summary: bytes, width: int):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.vectors = np.frombuffer(vectors, "<i8").reshape(len(self.ids), width)
        self.levels = []
        if summary:
            level = np.frombuffer(summary, "<f8").reshape(len(self.ids), 2, -1)
            norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))[:, None]
            while True:
                root = np.sqrt(width / level.shape[2])
                self.levels.insert(0, (root * level[:, 0], root * level[:, 1], norms))
                if level.shape[2] == 1:
                    break
                level = coarser(level)

    def upper(self, level: int, rows: np.ndarray, sign: int = 1) -> np.ndarray:
        """Multiplied with another side's lower() gives bounds; the norms make up for rounding."""
        mean, deviation, norms = self.levels[level]
        return np.concatenate([mean[rows], sign * deviation[rows], sign * 1e-9 * norms[rows]], axis=1)

    def lower(self, level: int, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([x[rows] for x in self.levels[level]], axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b; by floats where those are exact."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def candidates(a: Side, b: Side, ai: np.ndarray, bi: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b, and which of their pairs can score at least low (of a's row) and at most high: level by level on what is left."""
    mask = np.ones((len(ai), len(bi)), bool)
    for level in range(len(a.levels)):
        other = b.lower(level, bi).T
        mask &= a.upper(level, ai) @ other >= low[:, None]
        if high is not None:
            mask &= a.upper(level, ai, -1) @ other <= high[:, None]
        rows, columns = mask.any(axis=1), mask.any(axis=0)
        ai, bi, low, mask = ai[rows], bi[columns], low[rows], mask[rows][:, columns]
        high = None if high is None else high[rows]
        if not mask.size:
            break
    return ai, bi, mask


def scored(a: Side, b: Side, ai: np.ndarray, bi: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs of mask as floats' integers, _NEVER elsewhere; few pairs are scored one by one."""
    if mask.sum() * 8 < mask.size:
        i, j = np.nonzero(mask)
        out, step = np.full(mask.shape, np.iinfo(np.int64).min), max(1, NUMBERS // a.vectors.shape[1])
        for at in range(0, len(i), step):
            x, y = i[at : at + step], j[at : at + step]
            out[x, y] = (a.vectors[ai[x]] * b.vectors[bi[y]]).sum(axis=1)
        return out
    return np.where(mask, exact(a.vectors[ai], b.vectors[bi]), np.iinfo(np.int64).min)


class Best:
    """For each of n slots the first k by score and id among what was offered."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """The score that is needed to come in."""
        return self.scores[:, -1]

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each slot, a column for each of ids; the least integer is none."""
        none, k = np.iinfo(np.int64).min, self.k
        if scores.shape[1] > k:
            cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            chosen = (scores >= np.maximum(cut, self.scores[slots, -1])[:, None]) & (scores > none)
        else:
            chosen = scores > none
        i, j = np.nonzero(chosen)
        if not len(i):
            return
        touched, own = np.unique(i, return_inverse=True)
        row = np.concatenate([own, np.repeat(np.arange(len(touched)), k)])
        value = np.concatenate([scores[i, j], self.scores[slots[touched]].ravel()])
        name = np.concatenate([ids[j], self.ids[slots[touched]].ravel()])
        order = np.lexsort((name, ~value, row))
        first = order[np.searchsorted(row[order], np.arange(len(touched)))[:, None] + np.arange(k)]
        self.scores[slots[touched]], self.ids[slots[touched]] = value[first], name[first]


def blocked(rows: DataFrame, width: int, size: int, many: int) -> DataFrame:
    """Stored blocks of rows (vec_id, label, vector) in order of label: block, low and high label, n, ids, labels, vectors, summary."""

    def block(given):
        import pyarrow as pa
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []

        def made(some):
            vectors = np.zeros((len(some), width), np.int64)
            for i, r in enumerate(some):
                vectors[i, : len(r["vector"])] = r["vector"]
            labels = np.array([r["label"] for r in some], np.int64)
            segments = max((s for s in SEGMENTS if s < width), default=0)
            summary = summaries(vectors, segments).astype("<f8").tobytes() if segments else b""
            row = {
                "block": part << 32 | k, "low": int(labels.min()), "high": int(labels.max()), "ids": np.array([r["vec_id"] for r in some], "<i8").tobytes(),
                "labels": labels.astype("<i8").tobytes(), "vectors": vectors.astype("<i8").tobytes(), "summary": summary,
            }
            return pa.RecordBatch.from_pylist([row], pa.schema([(n, pa.int64() if i < 3 else pa.binary()) for i, n in enumerate(row)]))

        for batch in given:
            held += batch.to_pylist()
            while len(held) >= size:
                yield made(held[:size])
                held, k = held[size:], k + 1
        if held:
            yield made(held)

    order = [F.col("label"), F.xxhash64("vec_id", "vector")]
    ranged = rows.repartitionByRange(many, *order).sortWithinPartitions(*order)
    return stored(ranged.mapInArrow(block, "block long, low long, high long, ids binary, labels binary, vectors binary, summary binary"), "vector-blocks", "zstd")


def meetings(anchors: DataFrame, rows: DataFrame, lanes: int, same_label: bool) -> DataFrame:
    """Blocks of anchors (a_...) beside blocks of rows: every pair, or those whose labels overlap.

    By a shuffle: by the size of its compressed files a table of blocks may look fit for a broadcast, but each lane has a
    copy of it. A lane's pairs follow each other by blocks of anchors, so that thresholds are carried from block to block.
    """
    # blocks are numbered by partition and place in it, so neighbours go to different lanes
    here = rows.withColumn("lane", F.expr(f"pmod(shiftright(block, 32) + (block & 4294967295), {lanes})"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))
    there = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], every.alias("lane"))
    both = there.hint("merge").join(here.hint("merge"), "lane")
    return both.where("a_high >= low AND a_low <= high") if same_label else both


def positives_met(a: Side, b: Side, best: Best) -> None:
    for label in np.intersect1d(a.labels, b.labels):
        ai, bi = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
        ai, bi, mask = candidates(a, b, ai, bi, best.least()[ai].astype(np.float64))
        mask &= a.ids[ai][:, None] != b.ids[bi]
        if mask.any():
            best.offer(ai, scored(a, b, ai, bi, mask), b.ids[bi])


def bands(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that a negative of each positive score may have."""
    return -((-LOW * scores) // 100), HIGH * scores // 100


def negatives_met(a: Side, b: Side, positive: np.ndarray, known: np.ndarray, best: Best) -> None:
    """positive: scores, anchors x POSITIVES (known where there is one); slots of best follow each other in that order."""
    n, k = positive.shape
    low, high = bands(positive)
    low = np.maximum(low, best.least().reshape(n, k))
    open_ = known & (low <= high)
    least = np.where(open_, low.astype(np.float64), np.inf).min(axis=1)
    most = np.where(open_, high.astype(np.float64), _NEVER).max(axis=1)
    ai = np.flatnonzero(open_.any(axis=1))
    ai, bi, mask = candidates(a, b, ai, np.arange(len(b.ids)), least[ai], most[ai])
    mask &= a.labels[ai][:, None] != b.labels[bi]
    if not mask.any():
        return
    scores, none = scored(a, b, ai, bi, mask), np.iinfo(np.int64).min
    for t in range(k):
        wanted = open_[ai, t]
        own = scores[wanted]
        inside = (own >= low[ai[wanted], t][:, None]) & (own <= high[ai[wanted], t][:, None])
        if inside.any():
            best.offer(ai[wanted] * k + t, np.where(inside, own, none), b.ids[bi])


def first_of(pairs: DataFrame, width: int, negatives: bool) -> DataFrame:
    """a_block, slot, anchor_id, score, id, rank: the first of each slot of the blocks of anchors, from what each task found best."""

    def meet(given):
        import pyarrow as pa

        names, held, of = ["a_block", "slot", "anchor_id", "score", "id"], None, POSITIVES if negatives else 1

        def rows():
            best = held[2]
            slot, at = np.nonzero(best.scores > np.iinfo(np.int64).min)
            columns = [np.full(len(slot), held[0]), slot, held[1].ids[slot // of], best.scores[slot, at], best.ids[slot, at]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

        for batch in given:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if held is None or held[0] != r["a_block"]:
                    if held is not None:
                        yield rows()
                    a = Side(r["a_ids"], r["a_labels"], r["a_vectors"], r["a_summary"], width)
                    n, known, positive = len(a.ids), None, None
                    if negatives:
                        positive, known = np.zeros((n, POSITIVES), np.int64), np.zeros((n, POSITIVES), bool)
                        for p in r["a_positives"]:
                            positive[p["slot"], p["rank"] - 1], known[p["slot"], p["rank"] - 1] = p["score"], True
                    held = (r["a_block"], a, Best(n * POSITIVES, NEGATIVES) if negatives else Best(n, POSITIVES), positive, known)
                b = Side(r["ids"], r["labels"], r["vectors"], r["summary"], width)
                if negatives:
                    negatives_met(held[1], b, held[3], held[4], held[2])
                else:
                    positives_met(held[1], b, held[2])
        if held is not None:
            yield rows()

    found = pairs.mapInArrow(meet, "a_block long, slot long, anchor_id long, score long, id long")
    order = Window.partitionBy("a_block", "slot").orderBy(F.desc("score"), "id")
    most = NEGATIVES if negatives else POSITIVES
    with rows_per_batch(pairs.sparkSession, 8):
        partial = stored(found, "best")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score from rows (vec_id, label, vector of longs).

    An anchor's positives are its first POSITIVES other rows of its label; of each, the first NEGATIVES rows of other labels
    with LOW to HIGH hundredths of its score.
    """
    spark = rows.sparkSession
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)").select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), "vector", is_anchor.alias("is_anchor"))
    n, n_anchors, longest = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    width = 1 << (max(1, longest) - 1).bit_length()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocked(rows, width, block_rows, max(1, min(wanted, -(-n // 512)), -(-n // (block_rows * LANE_BLOCKS))))
    anchors = blocked(rows.where("is_anchor"), width, block_anchors, max(1, -(-n_anchors // block_anchors)))
    many = blocks.count()
    lanes = max(1, min(many, wanted), -(-many // LANE_BLOCKS))
    first = stored(first_of(meetings(anchors, blocks, lanes, True), width, False), "positives")
    of_block = first.groupBy("a_block").agg(F.collect_list(F.struct("slot", F.col("rank"), "score")).alias("positives"))
    found = first_of(meetings(anchors.hint("merge").join(of_block.withColumnRenamed("a_block", "block"), "block"), blocks, lanes, False), width, True)
    # slots of negatives are those of positives times POSITIVES, and the positive's rank less 1
    named = found.select(
        "anchor_id", "a_block", F.expr(f"slot div {POSITIVES}").alias("slot"), F.expr(f"CAST(slot % {POSITIVES} AS INT) + 1").alias("positive_rank"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    of_rank = first.select("a_block", "slot", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(of_rank, ["a_block", "slot", "positive_rank"]).select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")


def scaled(embedding: str) -> Column:
    """The components times 256, rounded down, as longs; null if the vector is, or one of its components is null or not finite."""
    x = f"transform({embedding}, x -> CAST(x AS DOUBLE))"
    return F.expr(f"CASE WHEN NOT exists({x}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) THEN transform({x}, x -> CAST(floor(256 * x) AS BIGINT)) END")


def mined_embeddings(table: DataFrame) -> DataFrame:
    """The query's rows and anchors: every seventh id has the next label, every fiftieth is an anchor."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label")
    return hard_negatives(table.select("vec_id", label, scaled("embedding").alias("vector")), F.expr("vec_id % 50 = 0"))
