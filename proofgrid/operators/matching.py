"""Pairs of alike names without all pairs: bounds of the Ratcliff-Obershelp ratio, and an index of rare pieces.

The ratio of names a and b is 2 * M / (|a| + |b|), M the characters in matching blocks. M is at most the characters that
both have (each as often as both have it), so a ratio of t needs t * (|a| + |b|) / 2 of those, and lengths within a factor
of t / (2 - t). Blocks are at most 1 + (1 - t) * (|a| + |b|), and one of n characters holds n - 1 character pairs; so above
t = 2/3 longer names also share at least (1.5 * t - 1) * (|a| + |b|) - 1 pairs. In one order of pieces from rare to common,
two names that share that many have one in common among their first n - needed + 1: only names that meet there are
compared, first by the characters they share, then by the ratio itself. Equal names are one name first.

Nulls, ties and odd input: null or blank names match nothing; null blocks match null blocks; equal rows are one name, for
which the smallest id stands; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from ..sources.shared import held
from .analysis import er_state, name_similarity


def labelled(items: Column) -> Column:
    """Each item with the number of equal ones before it, so that arrays of them intersect as multisets."""
    return bound(items, lambda all_: F.transform(all_, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(all_, F.lit(1), i), lambda y: y == x)).cast("string"))))


def characters(name: Column) -> Column:
    return labelled(F.filter(F.split(name, ""), lambda c: c != ""))


def character_pairs(name: Column) -> Column:
    return labelled(F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, F.lit(2))))


def needed_characters(n: Column, threshold: float) -> Column:
    """The least number of characters that a name of n shares with any that is alike."""
    return F.ceil(n * F.lit(threshold / (2 - threshold)) - F.lit(1e-9))


def needed_pairs(n: Column, threshold: float) -> Column:
    return F.ceil(n * F.lit(2 * (1.5 * threshold - 1) / (2 - threshold)) - F.lit(1 + 1e-9))


def longest_by_characters(threshold: float) -> int:
    """Names up to that length need no character pair in common for certain."""
    share = 2 * (1.5 * threshold - 1) / (2 - threshold)
    return ceil(2 / share) if share > 0 else 1 << 30


def meeting(names: DataFrame, blocks: list[str], pieces: Column, need: Column) -> DataFrame:
    """left_id, right_id: names (id, name, n, blocks) with a piece in common among their rare ones that must hold one."""
    rows = names.select(*blocks, "id", "n", need.alias("need"), F.explode(pieces).alias("piece"))
    often = rows.groupBy(*blocks, "piece").agg(F.count(F.lit(1)).alias("often"))
    both = lambda a, b, columns: " AND ".join(f"{a}.{c} <=> {b}.{c}" for c in columns)
    ranked = rows.alias("r").join(often.alias("o"), F.expr(both("r", "o", [*blocks, "piece"]))).select("r.*", "o.often")
    order = Window.partitionBy("id").orderBy("often", "piece")
    first = ranked.withColumn("turn", F.row_number().over(order)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("id"))).where("turn <= all - need + 1 AND often > 1")
    first = held(first.select(*blocks, "id", "n", "piece"))
    pairs = first.alias("a").join(first.alias("b"), F.expr(both("a", "b", [*blocks, "piece"]))).where("a.id < b.id")
    return pairs.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.col("a.n").alias("left_n"), F.col("b.n").alias("right_n")).distinct()


def alike(entities: DataFrame, blocks: list[str], threshold: float) -> DataFrame:
    """left_id, right_id, score, state of all pairs of names (id, name, blocks) of one block whose ratio is threshold or more."""
    norm = F.lower(F.trim("name"))
    names = entities.where(norm != "").groupBy(*blocks, norm.alias("name")).agg(F.min("id").alias("id")).withColumn("n", F.length("name"))
    names = held(names.withColumn("chars", characters(F.col("name"))))
    longest = longest_by_characters(threshold)
    short = names.where(F.col("n") <= F.lit(longest * (2 - threshold) / threshold))
    long = names.where(F.col("n") > longest)
    met = meeting(short, blocks, F.col("chars"), needed_characters(F.col("n"), threshold)).union(meeting(long, blocks, character_pairs(F.col("name")), needed_pairs(F.col("n"), threshold)))
    sized = met.distinct().where(F.least("left_n", "right_n") * 2 >= (F.col("left_n") + F.col("right_n")) * F.lit(threshold - 1e-9))
    side = lambda s: names.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.col("chars").alias(f"{s}_chars"))
    full = sized.join(side("left"), "left_id").join(side("right"), "right_id")
    enough = F.size(F.array_intersect("left_chars", "right_chars")) * 2 >= (F.col("left_n") + F.col("right_n")) * F.lit(threshold - 1e-9)
    scored = full.where(enough).withColumn("score", name_similarity("left_name", "right_name")).where(F.col("score") >= threshold)
    return scored.select("left_id", "right_id", "score", er_state(F.col("score")).alias("state"))
