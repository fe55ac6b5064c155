"""Packing documents into sequences of 4096 tokens by non-negative least squares on a histogram of lengths.

A document's tokens are cut into whole windows, a head of a multiple of UNIT tokens and a tail below UNIT. Shallow
combinations (up to four heads) that fill a window exactly are enumerated; non-negative least squares solves how often to
repeat each against the histogram of heads, and the counts are rounded down so that no combination lacks heads. Heads
that are left over and the tails are packed greedily end to end and cut at window ends; the rest below a window is cut at
powers of two, which need no padding, so the mix has none at all.

The solution depends on 63 counts whatever the input, and assigns heads by their rank within their length. Ranks and
offsets are two-level (hash buckets, then bucket offsets), so no source or length is ranked in one task. Token ids are
stored bit-packed once, and pieces meet them by a row number stored with them.

Nulls, ties and odd input: a null text is empty and is packed as its end id alone; null ids and rows that repeat an id
are packed each; the result is stable for a given table; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, stored, text_or_empty
from .token_store import bits_for, pack, unpack
from .tokens import END_ID, VOCABULARY, shared_tokenizer

WINDOW, UNIT, DEPTH = 4096, 64, 4


def combinations(units: int = WINDOW // UNIT, depth: int = DEPTH) -> np.ndarray:
    """One row for each multiset of 2 to depth lengths that sum to units: how often it has each length 1 .. units - 1."""
    found: list[list[int]] = []

    def grow(parts: list[int], rest: int):
        if rest == 0 and len(parts) > 1:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(parts[-1] if parts else 1, min(rest, units - 1) + 1):
                if len(parts) + 1 < depth and rest - x >= x or rest == x:
                    grow([*parts, x], rest - x)

    grow([], units)
    out = np.zeros((len(found), units - 1), np.int64)
    for k, parts in enumerate(found):
        np.add.at(out[k], np.array(parts) - 1, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method: the column with the largest gradient enters, and columns
    that turn negative leave."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gradient = a.T @ b
    for _ in range(rounds):
        if active.all() or gradient[~active].max(initial=0) <= 1e-9 * max(1.0, np.abs(b).max(initial=0)):
            break
        active[np.where(active, -np.inf, gradient).argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min(initial=1) > 0:
                break
            low = active & (s <= 0)
            x += (x[low] / np.maximum(x[low] - s[low], 1e-300)).min() * (s - x)
            active &= x > 1e-9
            x[~active] = 0
            if not active.any():
                s = x
                break
        x = s
        gradient = a.T @ (b - a @ x)
    return x


def recipes(histogram: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Combinations to use and how often, never more heads than the histogram has of any length.

    The least-squares counts are scaled down where they ask for more heads of a length than are left, and rounded down;
    what remains of the histogram is solved again until a round uses little.
    """
    table, left = combinations(len(histogram) + 1), histogram.astype(np.int64).copy()
    total = np.zeros(len(table), np.int64)
    for _ in range(rounds):
        wanted = nnls(table.T.astype(float), left.astype(float))
        held = np.minimum(1.0, left / np.maximum(wanted @ table, 1e-9))
        counts = np.floor(wanted * np.where(table > 0, held, 1.0).min(axis=1) + 1e-9).astype(np.int64)
        left -= counts @ table
        total += counts
        if counts.sum() * 1000 <= total.sum():
            break
    return table[total > 0], total[total > 0]


def tokenised(docs: DataFrame, tokenizer_path: str | None = None, vocabulary: int = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, n and packed ids of every document, stored; row numbers its rows."""
    bits = bits_for(vocabulary)

    def encode(batches):
        import pyarrow as pa

        tokenizer = shared_tokenizer(tokenizer_path)
        for some in chunks(batches):
            ids = [tokenizer.encode(r["text"], end_id) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in some], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack(x, bits) for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    encoded = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(encode, "doc_id long, n long, ids binary")
    return stored(encoded.select(F.monotonically_increasing_id().alias("row"), "*"), "packing-tokens")


def before(rows: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`: the sum of `value` over the rows before in (keys, bucket, order), in two levels; needs `bucket`."""
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "bucket").agg(F.sum(value).alias("own_sum"))
    sums = sums.select(*keys, "bucket", F.coalesce(F.sum("own_sum").over(earlier), F.lit(0)).alias("offset"))
    summed = rows.withColumn("until", F.sum(value).over(inside)).join(sums, [*keys, "bucket"])
    return summed.withColumn(name, F.col("offset") + F.col("until") - F.col(value)).drop("until", "offset")


def tape_ends(total: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """The rest of the tape below a window, cut at powers of two from the largest."""
    at, out = total - total % window, []
    for k in range(window.bit_length() - 1, -1, -1):
        if total % window >> k & 1:
            out.append((at, at + (1 << k)))
            at += 1 << k
    return out


def packed_pieces(lengths: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """row, start, length, sequence_id, offset of every piece for lengths (row, n)."""
    spark = lengths.sparkSession
    rows = lengths.agg(F.count(F.lit(1))).first()[0]
    buckets = max(256, math.isqrt(rows))
    cut = lengths.select(
        "row", "n", F.floor(F.col("n") / window).alias("windows"), F.floor(F.col("n") % window / unit).cast("int").alias("units"), (F.col("n") % unit).alias("tail"), F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")
    )
    cut = cut.withColumn("one", F.when(F.col("units") > 0, 1).otherwise(0))
    histogram = np.zeros(window // unit - 1, np.int64)
    for units, n in cut.where("units > 0").groupBy("units").count().collect():  # at most window / unit - 1 rows
        histogram[units - 1] = n
    table, counts = recipes(histogram)
    # of each length, the heads of rank [low, high) go to place `slot` of recipe `recipe`'s repeats, one each
    plan, taken, base = [], np.zeros(len(histogram), np.int64), 0
    for parts, times in zip(table, counts, strict=True):
        offset = 0
        for units in np.repeat(np.arange(1, len(histogram) + 1), parts):
            low = int(taken[units - 1])
            plan.append((int(units), low, low + int(times), base, offset * unit))
            taken[units - 1] += int(times)
            offset += int(units)
        base += int(times)
    plan = spark.createDataFrame(plan, "units int, low long, high long, base long, offset long")  # at most (window / unit) * DEPTH rows
    ranked = before(before(cut, "windows", [], ["row"], "windows_before"), "one", ["units"], ["row"], "rank")
    placed = stored(ranked.join(F.broadcast(plan), (ranked["units"] == plan["units"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left").select(
        "row", "n", "windows", ranked["units"], "tail", "bucket", "windows_before", (F.col("base") + F.col("rank") - F.col("low")).alias("head_sequence"), "offset"
    ), "packing-places")
    loose = placed.select(
        "row", "bucket", (F.col("windows") * window + F.when(F.col("head_sequence").isNull(), 0).otherwise(F.col("units") * unit)).alias("start"), "n"
    ).withColumn("length", F.col("n") - F.col("start")).where("length > 0")
    on_tape = before(loose, "length", [], ["row"], "at")
    whole, total = placed.agg(F.coalesce(F.sum("windows"), F.lit(0)), F.coalesce(F.sum(F.col("n") - F.col("windows") * window - F.when(F.col("head_sequence").isNull(), 0).otherwise(F.col("units") * unit)), F.lit(0))).first()
    full = total // window
    ends = [(low, high, full + k) for k, (low, high) in enumerate(tape_ends(total, window))]
    windows = f"transform(IF(at < {full * window}L, sequence(at div {window}, least((at + length - 1) div {window}, {full - 1}L)), array()), w -> struct(w * {window}L AS low, (w + 1) * {window}L AS high, w AS nth))"
    rest = "array(" + ", ".join(f"struct({a}L AS low, {b}L AS high, {k}L AS nth)" for a, b, k in ends) + ")"
    spans = f"concat({windows}, filter({rest}, e -> e.low < at + length AND e.high > at))" if ends else windows
    cut_tape = on_tape.withColumn("span", F.explode(F.expr(spans)))
    low, high = F.greatest("at", "span.low"), F.least(F.col("at") + F.col("length"), F.col("span.high"))
    tape = cut_tape.select("row", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"), (F.col("span.nth") + F.lit(whole + base)).alias("sequence_id"), (low - F.col("span.low")).alias("offset"))
    heads = placed.where("head_sequence IS NOT NULL").select("row", (F.col("windows") * window).alias("start"), (F.col("units") * unit).cast("long").alias("length"), (F.col("head_sequence") + F.lit(whole)).alias("sequence_id"), "offset")
    wholes = placed.where("windows > 0").select("row", "windows_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("k")).select("row", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("windows_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return wholes.unionByName(heads).unionByName(tape)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, vocabulary: int = VOCABULARY, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    bits = bits_for(vocabulary)
    tokens = tokenised(docs, tokenizer_path, vocabulary, end_id)
    pieces = packed_pieces(tokens.select("row", "n"), window)
    # the pieces of one document, as many as its length has windows and a few more
    own = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))

    @F.pandas_udf("array<long>")
    def digests(ids: pd.Series, n: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for data, count, at, size in zip(ids, n, starts, lengths, strict=True):
            raw = unpack(data, bits, count).astype("<u4")
            out.append([zlib.crc32(raw[a : a + s].tobytes()) for a, s in zip(at, size, strict=True)])
        return pd.Series(out)

    joined = tokens.join(own, "row").withColumn("crc", digests("ids", "n", F.col("pieces.start"), F.col("pieces.length")))
    each = joined.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.arrays_zip("pieces", "crc")).alias("x"))
    return each.select("doc_id", "x.pieces.start", "x.pieces.length", F.col("x.crc").alias("ids_crc32"), "doc_tokens", "x.pieces.sequence_id", "x.pieces.offset")
