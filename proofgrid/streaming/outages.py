"""Outages of feeds as a stream with keyed state: each feed's last ones and how many there were, over batches and restarts.

The state of a feed is a ring of its last KEPT outages and a count, in Spark's state store under the checkpoint; a feed that
is quiet for longer than `forget` (by event time and watermark) is closed and its state goes. Feeds are dealt by hash over
LANES keys of the store, so that a batch costs at most that many calls of Python, however many feeds there are. Rows that come
late take their place in the ring by their time; those later than the watermark the engine drops.

Nulls, ties and odd input: polls without a feed or a time don't count; equal times go by error; a batch without outages
tells nothing; repeated polls are polls of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT, LANES = 50, 4096
RESULT = "feed string, n_outages long, first_at timestamp, last_at timestamp, n_kept int, oldest_kept timestamp, errors string, closed boolean"
#: One element a feed; ats and errors hold the rings of all one after the other, kept of each.
_STATE = "feeds array<string>, n array<long>, first array<long>, kept array<int>, ats array<long>, errors array<string>"


def outage_log(polls: DataFrame, kept: int = KEPT, late: str = "1 day", forget_ms: int = 30 * 86_400_000, lanes: int = LANES) -> DataFrame:
    """RESULT for each feed whose outages changed in a batch, and once when a feed is closed. polls: feed, at, ok, error; a stream."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, at = {}, 0
        if state.exists:
            feeds, n, first, counts, ats, errors = state.get
            for feed, many, since, length in zip(feeds, n, first, counts, strict=True):
                known[feed] = (many, since, list(zip(ats[at : at + length], errors[at : at + length], strict=True)))
                at += length
        new = {}
        if not state.hasTimedOut:
            for b in batches:
                for feed, t, e in zip(b["feed"], b["at"].to_numpy("datetime64[us]").astype("int64").tolist(), b["error"].fillna(""), strict=True):
                    new.setdefault(feed, []).append((t, e))
        for feed, rows in new.items():
            many, since, ring = known.get(feed, (0, None, []))
            since = min([t for t, _ in rows] + ([since] if since is not None else []))
            known[feed] = (many + len(rows), since, sorted(ring + rows)[-kept:])
        watermark = state.getCurrentWatermarkMs()
        ends = {feed: max(x[2][-1][0] // 1000, watermark if feed in new else 0) + forget_ms for feed, x in known.items()}
        closed = {feed for feed, end in ends.items() if end < watermark and feed not in new}
        told = [(feed, known[feed]) for feed in [*new, *closed]]
        for feed in closed:
            del known[feed]
        if known:
            rings = [o for _, _, ring in known.values() for o in ring]
            state.update((list(known), [x[0] for x in known.values()], [x[1] for x in known.values()], [len(x[2]) for x in known.values()], [t for t, _ in rings], [e for _, e in rings]))
            state.setTimeoutTimestamp(max(watermark + 1, min(ends[feed] for feed in known)))
        else:
            state.remove()
        when = lambda times: pd.to_datetime(pd.Series(times, dtype="int64"), unit="us")
        yield pd.DataFrame({
            "feed": [feed for feed, _ in told], "n_outages": [x[0] for _, x in told], "first_at": when([x[1] for _, x in told]), "last_at": when([x[2][-1][0] for _, x in told]), "n_kept": [len(x[2]) for _, x in told],
            "oldest_kept": when([x[2][0][0] for _, x in told]), "errors": [",".join(e for _, e in x[2][-3:]) for _, x in told], "closed": [feed in closed for feed, _ in told],
        })

    lost = polls.where("feed IS NOT NULL AND at IS NOT NULL AND NOT coalesce(ok, false)").select(F.pmod(F.xxhash64("feed"), F.lit(lanes)).alias("lane"), "feed", "at", "error").withWatermark("at", late)
    return lost.groupBy("lane").applyInPandasWithState(update, RESULT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run(log: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what is there; every feed's latest row of all batches so far."""
    spark = log.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    log.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{RESULT}, batch long").parquet(out)
    last = rows.groupBy("feed").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("feed", "batch")]), "batch").alias("x"))
    return last.select("feed", "x.*")
