"""Traces of transfers with a budget of lookups, depth first.

A trace visits an address, looks its neighbours up and goes into each of the first ones in turn before the next, down to a
depth, until its lookups are used up. Here a step is known by its path: the neighbours' places from the start, two digits
each, so that paths in text order are the trace's order. Levels are expanded by a join each, and of each start only the
first `calls` visited steps in that order are kept: deeper levels can but push further ones past the budget. What hangs
below the steps that are left at the end is the trace; its other steps are made only then.

Outcomes: `visited`; `budget` (visited, but no lookup was left); `boundary` (a labelled address, where a trace ends);
`invalid`; `too_deep`. An address may be visited more than once, as each way to it is told.

Nulls, ties and odd input: edges with a null end don't count, repeated ones count once; neighbours come in order of their
names; an address without neighbours is visited; a null start has no trace; repeated starts are one; no starts give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held


def budgeted_trace(edges: DataFrame, starts: DataFrame, boundaries: DataFrame, valid=None, depth: int = 3, fan_out: int = 10, calls: int = 25) -> DataFrame:
    """start_id, path, depth, address, outcome, label (of a boundary), call_no for traces from starts (start_id) along edges (source, target).

    boundaries: address, label. valid: says of the column "address" whether it is one; by default any is.
    """
    if fan_out > 100:
        raise ValueError("paths have two digits a step")
    # equal edges have one rank, so that each part of the edges is cut to its first neighbours before it is moved
    turn = Window.partitionBy("source").orderBy("target")
    first = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").withColumn("turn", F.dense_rank().over(turn)).where(F.col("turn") <= fan_out).distinct()
    labels = boundaries.groupBy(F.col("address").alias("labelled")).agg(F.min("label").alias("label"))
    fine = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))

    def judged(rows: DataFrame) -> DataFrame:
        """rows (address, ...) with outcome and label, whatever their depth."""
        outcome = F.when(~fine, "invalid").when(F.col("labelled").isNotNull(), "boundary").otherwise("visited")
        met = rows.join(labels, rows["address"] == labels["labelled"], "left")
        return met.select(*rows.columns, outcome.alias("outcome"), F.when(outcome == "boundary", F.col("label")).alias("label"))

    step = F.lpad((F.col("turn") - 1).cast("string"), 2, "0").alias("step")
    near = held(judged(first.select("source", F.col("target").alias("address"), step)))
    roots = held(judged(starts.where("start_id IS NOT NULL").select("start_id", F.col("start_id").alias("address")).distinct()))
    before = Window.partitionBy("start_id").orderBy("path")

    def counted(visited: DataFrame) -> DataFrame:
        return held(visited.select("start_id", "path", "depth", "address").withColumn("call_no", F.row_number().over(before)).where(F.col("call_no") <= calls))

    def below(asked: DataFrame) -> DataFrame:
        above = asked.select("start_id", "path", "depth", F.col("address").alias("source"))
        return above.join(near, "source").select("start_id", F.concat("path", "step").alias("path"), (F.col("depth") + 1).alias("depth"), "address", "outcome", "label")

    asked = counted(roots.where("outcome = 'visited'").select("start_id", F.lit("").alias("path"), F.lit(0).alias("depth"), "address"))
    for level in range(1, depth + 1):
        asked = counted(asked.drop("call_no").union(below(asked.where(F.col("depth") == level - 1)).where("outcome = 'visited'").select("start_id", "path", "depth", "address")))
    met = below(asked).select("start_id", "path", "depth", "address", F.when(F.col("depth") > depth, "too_deep").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("depth") <= depth, F.col("label")).alias("label"))
    every = roots.select("start_id", F.lit("").alias("path"), F.lit(0).alias("depth"), "address", "outcome", "label").union(met)
    numbered = every.join(asked.select("start_id", "path", F.col("call_no").cast("long").alias("call_no")), ["start_id", "path"], "left")
    late = (F.col("outcome") == "visited") & F.col("call_no").isNull()
    return numbered.select("start_id", "path", "depth", "address", F.when(late, "budget").otherwise(F.col("outcome")).alias("outcome"), "label", "call_no")


def trace_summary(trace: DataFrame) -> DataFrame:
    """start_id, calls, n_visited, n_boundaries, n_left (steps without a lookup for lack of budget), n_too_deep."""
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return trace.groupBy("start_id").agg(of("visited").alias("calls"), of("visited", "budget").alias("n_visited"), of("boundary").alias("n_boundaries"), of("budget").alias("n_left"), of("too_deep").alias("n_too_deep"))
