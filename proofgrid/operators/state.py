"""State machines, budgets, plans and rankings.

A machine's events of a key compose: the events of a chunk (a day, say) are folded into a map from each state to the
state after the chunk, and the maps of a key are folded in order. So a key with very many events is folded in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The lifecycle of a hypothesis, each state with the states that may follow.
LIFECYCLE = {
    "proposed": ("active", "archived"),
    "active": ("testing", "archived"),
    "testing": ("strengthened", "weakened", "supported", "disputed", "falsified", "inconclusive"),
    "strengthened": ("testing", "supported", "disputed", "falsified"),
    "weakened": ("testing", "disputed", "falsified", "inconclusive"),
    "supported": ("testing", "disputed", "falsified", "archived"),
    "disputed": ("testing", "falsified", "inconclusive", "archived"),
    "falsified": ("archived",),
    "inconclusive": ("testing", "archived"),
    "archived": (),
}


def allowed(table: dict[str, tuple[str, ...]], state: Column, event: Column) -> Column:
    """The state after an event that asks for a state: that one if it may follow, else the same."""
    moves = F.create_map(*[x for s, after in table.items() for x in (F.lit(s), F.array(*map(F.lit, after)).cast("array<string>"))])
    return F.when(F.array_contains(F.element_at(moves, state), event), event).otherwise(state)


def folded(events: DataFrame, key: str, chunk: str, order: str, event: str, start: str, table: dict[str, tuple[str, ...]] = LIFECYCLE) -> DataFrame:
    """key, state, n_events: the state of each key after all its events."""
    states = F.array(*map(F.lit, table))
    chunks = events.groupBy(key, chunk).agg(F.array_sort(F.collect_list(F.struct(order, event))).alias("list"), F.count(F.lit(1)).alias("n"))
    after = F.transform(states, lambda s: F.aggregate("list", s, lambda state, e: allowed(table, state, e[event])))
    maps = chunks.select(key, chunk, "n", F.map_from_arrays(states, after).alias("move"))
    whole = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("chunk"), F.map_entries("move").alias("move")))).alias("moves"), F.sum("n").alias("n_events"))
    end = F.aggregate("moves", F.lit(start), lambda state, m: F.element_at(F.map_from_entries(m["move"]), state))
    return whole.select(key, end.alias("state"), "n_events")


def ready(tasks: DataFrame, depends: DataFrame) -> DataFrame:
    """Open tasks (task_id, done) all of whose dependencies are done."""
    unmet = depends.join(tasks.where("NOT done").select(F.col("task_id").alias("depends_on")), "depends_on", "left_semi").select("task_id").distinct()
    return tasks.where("NOT done").select("task_id").join(unmet, "task_id", "left_anti")


def plan_minutes(waves: DataFrame, concurrency: int = 4, seconds: float = 8.0) -> DataFrame:
    """One row: tasks, waves, minutes; each wave runs its tasks `concurrency` at a time."""
    per = waves.groupBy("wave").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("tasks"), F.count(F.lit(1)).alias("waves"), F.round(F.sum(F.greatest(F.lit(1), F.floor(F.col("n") / concurrency))) * seconds / 60, 2).alias("minutes"))


def budget_snapshot(entries: DataFrame) -> DataFrame:
    """key, spent, held, refunded of reservations (key, reservation_id, seq, kind, amount): the last entry of each counts."""
    last = entries.groupBy("key", "reservation_id").agg(F.max_by(F.struct("kind", "amount"), "seq").alias("x"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("x.kind") == kind, F.col("x.amount"))), F.lit(0))
    return last.groupBy("key").agg(total("commit").alias("spent"), total("hold").alias("held"), total("refund").alias("refunded"))


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, the value that occurs most (the first in order among equals), its share."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("value"))).alias("best"), F.sum("n").alias("total"))
    return best.select(*keys, F.col("best.value").alias("majority"), F.round(-F.col("best.less") / F.col("total"), 6).alias("share"))


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
