"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a row of slots, each of one block of equal tokens. Slot i has the point frac(i * golden ratio), which falls into
one source's share of [0, 1); slots are ranked within their source, and the n-th slot of a source gets the n-th block of
that source's tape of shuffled documents. So the slots that a source gets decide how much of it is taken, and slot order is
the order of the mix. A tape runs over the source's documents once or twice, so nothing is taken more than twice.

Every ranking is two-level (buckets of a hash, or chunks of slots, then offsets of the buckets), so that a source with a
third of all rows is spread over many tasks; only the list of sources itself is ordered in one task, so there may be some
hundred thousand of them. Nulls and odd input: a null text has size 0; a null source is a source, last in order; null ids
and repeated rows are documents of their own, and rows that repeat id, source and text give the mix the columns of one of
them; an empty table, or one without words, takes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, WORD, stored, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
#: A block has at most so many words, and fewer where the mix would have less than LEAST_SLOTS slots.
BLOCK_TOKENS, LEAST_SLOTS = 4096, 1 << 16
#: Fibonacci hashing: 2**32 / golden ratio, so that i * GOLDEN mod 2**32 is the golden-ratio sequence in 32-bit steps.
GOLDEN = 2654435769


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest of the text, size: the number of words of the whole text."""
    text = text_or_empty()
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.md5(text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, n_docs, target for each source: shares by weight, none above `most` times its size.

    Resharing the excess by weight until none is above ends where every source has min(most * size, level * weight), and
    the level follows from the sources in order of size over weight.
    """
    everything = Window.partitionBy(F.lit(0))
    by_code_point = everything.orderBy(F.col("source").asc_nulls_last())
    filling = everything.orderBy(F.col("full_at"), F.col("place"))
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("place", F.row_number().over(by_code_point))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * float(share))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
        .select("source", "source_size", "n_docs", "place", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def laid_out(sizes: DataFrame, rows: int) -> DataFrame:
    """sizes with place of the row in its source's shuffled order: bucket, nth (together unique) and start (words before it)."""
    buckets = max(256, math.isqrt(rows))
    at = F.xxhash64(F.lit("mixing"), "doc_id", "digest")
    keyed = sizes.withColumn("order", at).withColumn("bucket", F.pmod(F.xxhash64("order"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("place", "bucket").orderBy("order", "doc_id", "digest")
    local = keyed.withColumn("nth", F.row_number().over(inside)).withColumn("until", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    offsets = keyed.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("place", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    return local.join(offsets, ["place", "bucket"]).withColumn("start", F.col("offset") + F.col("until") - F.col("size")).drop("offset", "until", "order")


def block_width(total: float, most: int = BLOCK_TOKENS) -> int:
    """Words of a block for a mix of so many words."""
    return int(min(most, max(1, total // LEAST_SLOTS)))


def golden_points(slots: DataFrame):
    """slots with `point`: the fractional part of slot * golden ratio."""
    return slots.withColumn("point", F.pmod(F.col("slot") % (1 << 31) * GOLDEN, F.lit(1 << 32)) / float(1 << 32))


def schedule(targets: DataFrame, width: int, points=golden_points) -> DataFrame:
    """slot, place (of the source) and nth (of the slot among its source's), for blocks of `width` words. Sources that no point falls into get one slot more."""
    spark = targets.sparkSession
    total, many = targets.agg(F.sum("target"), F.count(F.lit(1))).first()
    slots = math.ceil((total or 0) / width)
    cells = 4 * many + 1
    order = Window.partitionBy(F.lit(0)).orderBy("place")
    shares = (
        targets.where("target > 0")
        .withColumn("high", F.sum("target").over(order) / F.lit(total or 1.0))
        .withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
        .withColumn("high", F.when(F.lead("place").over(order).isNull(), F.lit(2.0)).otherwise(F.col("high")))
    )
    by_cell = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long")))))
    placed = points(spark.range(slots).select(F.col("id").alias("slot"))).withColumn("cell", F.floor(F.col("point") * cells))
    chosen = placed.join(by_cell, "cell").where("point >= low AND point < high").select("slot", "place")
    missing = shares.select("place").join(chosen.select("place").distinct(), "place", "left_anti").select((F.lit(slots) + F.col("place")).alias("slot"), "place")
    chosen = chosen.unionByName(missing)
    chunk = max(128, math.isqrt(slots))
    keyed = chosen.withColumn("chunk", F.floor(F.col("slot") / chunk))
    inside = Window.partitionBy("place", "chunk").orderBy("slot")
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return keyed.withColumn("local", F.row_number().over(inside)).join(counts, ["place", "chunk"]).select("slot", "place", (F.col("offset") + F.col("local") - 1).alias("nth"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, block: int = BLOCK_TOKENS, points=golden_points, sizes: DataFrame | None = None) -> DataFrame:
    """Pieces of the mix: doc_id, digest, source, size, source_size, target, row, copy, slot, words; their order is (slot, copy, row).

    `row` tells documents with equal ids apart. Documents of which nothing is taken have one piece with a null slot and 0 words.
    sizes: what sized() says of docs, if at hand.
    """
    sizes = stored(sized(docs), "mixing-sizes") if sizes is None else sizes
    targets = stored(source_targets(sizes, weights, share, most), "mixing-targets")
    many, total, rows = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    width = block_width(total, block)
    slots = stored(schedule(targets, width, points), "mixing-slots")
    counts = slots.groupBy("place").agg(F.count(F.lit(1)).alias("slots"))
    known = targets.join(counts, "place", "left").select("place", F.col("source").alias("its_source"), "source_size", "target", F.coalesce("slots", F.lit(0)).alias("slots"))
    placed = sizes.join(F.broadcast(known) if many <= 100_000 else known, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    # a source's slots take so many words of its tape; the last may find the tape at its end
    tape = laid_out(placed, rows).withColumn("taken", F.least(F.col("slots") * width, F.col("source_size") * most))
    copy = F.explode_outer(F.expr(f"filter(sequence(0, {most - 1}), c -> size > 0 AND c * source_size + start < taken)"))
    copies = (
        tape.withColumn("copy", copy)
        .withColumn("from", F.col("copy") * F.col("source_size") + F.col("start"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("taken")))
    )
    # block n of a source is [n * width, (n + 1) * width) of its tape
    first, last = F.expr(f"from div {width}"), F.expr(f"(to - 1) div {width}")
    cut = copies.withColumn("nth_block", F.explode_outer(F.sequence(first, last)))
    cut = cut.withColumn("words", F.least("to", (F.col("nth_block") + 1) * width) - F.greatest("from", F.col("nth_block") * width))
    joined = cut.join(slots.select("place", F.col("nth").alias("nth_block"), "slot"), ["place", "nth_block"], "left")
    return joined.select(
        "doc_id", "digest", "source", "size", "source_size", "target", F.struct("place", "bucket", "nth").alias("row"), "copy", "slot", F.coalesce("words", F.lit(0)).cast("long").alias("words")
    )


def mix_totals(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs."""
    return (
        mix_sources(docs, **options)
        .groupBy("row", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum("words").alias("taken"))
        .drop("row")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of docs, in the order of the mix: whole copies, and the first words of those taken in part.

    A copy stands where its first block's slot does; rows are dealt to partitions by ranges of slots and ordered in them.
    """
    keys = ["doc_id", "source", "digest"]
    sizes = stored(sized(docs), "mixing-sizes")
    copies = mix_sources(docs, sizes=sizes, **options).where("words > 0").groupBy("row", "copy", *keys, "size").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    names = {"doc_id": "__its_id", "source": "__its_source", "digest": "__its_digest", "size": "__its_size", "taken": "__taken", "slot": "__slot", "copy": "__copy", "row": "__row"}
    copies = stored(copies.withColumnsRenamed(names), "mixing-copies")
    slots = (copies.agg(F.max("__slot")).first()[0] or 0) + 1
    rows = docs.withColumn("__digest", F.md5(text_or_empty()))
    if not sizes.groupBy(*keys).count().where("count > 1").isEmpty():  # else texts need no shuffle to be told apart
        rows = rows.dropDuplicates(["doc_id", "source", "__digest"])
    joined = rows.join(copies, F.expr("doc_id <=> __its_id AND CAST(source AS string) <=> __its_source AND __digest = __its_digest"))
    first_words = F.array_join(F.slice(F.filter(F.split("text", WHITE), lambda w: w != ""), 1, F.col("__taken").cast("int")), " ")
    out = joined.withColumn("__new_text", F.when(F.col("__taken") < F.col("__its_size"), first_words).otherwise(F.col("text")))
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("__slot") * F.lit(many) / F.lit(slots)).cast("int")
    out = out.repartitionById(many, part).sortWithinPartitions("__slot", "__copy", "__row")
    return out.select(*[F.col("__new_text").alias(c) if c == "text" else F.length("__new_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns])
