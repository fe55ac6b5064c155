"""Graph operators over edge tables: neighbours, hops, shortest paths, components, waves, time slices.

Loops run on the driver, one join a level; each level's rows are checkpointed to the folder that spark.checkpoint.dir
names, so lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held, stored


#: Levels of at most that many rows come to the edges by broadcast; larger ones meet them by a shuffle.
FEW = 200_000


def pairs_of(edges: DataFrame) -> DataFrame:
    """x, y: the different pairs of ends, x being the smaller."""
    return edges.where("source <> target").select(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """a, b in both directions, each once; made of the different pairs, so that one row a pair is shuffled."""
    return both_ways(pairs_of(edges))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("e")).select("e.a", "e.b")


def neighbors(edges: DataFrame) -> DataFrame:
    """entity_id, neighbor_id, neighbor_kind; ids are kind:key."""
    return undirected(edges).select(F.col("a").alias("entity_id"), F.col("b").alias("neighbor_id"), F.substring_index("b", ":", 1).alias("neighbor_kind"))


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """start_id, entity_id, hops: the entities within depth hops of each start (column start_id), with the fewest hops.

    A level holds what is new in it; edges go both ways, so a level's neighbours lie in it or in the two beside it. Pairs
    are stored once, as Parquet, and read both ways by each level.
    """
    both = both_ways(stored(pairs_of(edges), "pairs", "zstd"))
    levels = [stored(starts.select("start_id", F.col("start_id").alias("entity_id"), F.lit(0).alias("hops")), "level", "zstd")]
    n = levels[0].count()
    while depth is None or len(levels) <= depth:
        last = F.broadcast(levels[-1]) if n <= FEW else levels[-1]
        step = last.join(both, levels[-1]["entity_id"] == both["a"]).select("start_id", F.col("b").alias("entity_id")).distinct()
        for near in levels[-2:]:
            step = step.join(near.select("start_id", "entity_id"), ["start_id", "entity_id"], "left_anti")
        found = stored(step.select("start_id", "entity_id", F.lit(len(levels)).alias("hops")), "level", "zstd")
        n = found.count()
        if not n:
            break
        levels.append(found)
    return reduce(DataFrame.union, levels)


def routes(edges: DataFrame, start: str) -> DataFrame:
    """entity_id, hops, route: a shortest way from one start to each entity; of several, the one whose last but one is least, and so on back."""
    both = held(undirected(edges))
    spark = edges.sparkSession
    levels = [held(spark.createDataFrame([(start, 0, [start])], "entity_id string, hops int, route array<string>"))]
    while True:
        step = levels[-1].join(both, levels[-1]["entity_id"] == both["a"]).groupBy(F.col("b").alias("entity_id")).agg(F.min_by("route", "a").alias("before"))
        for near in levels[-2:]:
            step = step.join(near.select("entity_id"), "entity_id", "left_anti")
        found = held(step.select("entity_id", F.lit(len(levels)).alias("hops"), F.concat("before", F.array("entity_id")).alias("route")))
        if found.isEmpty():
            break
        levels.append(found)
    return reduce(DataFrame.union, levels)


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """entity_id, component_id: the smallest id each entity is connected with; isolated vertices are their own.

    Each round points every id at its smallest neighbour and contracts the edges; half of the ids with edges go a round.
    """
    live = held(undirected(edges))
    found = vertices.select("entity_id", F.col("entity_id").alias("component_id"))
    while not live.isEmpty():
        points = held(live.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to")))
        found = held(found.join(points, found["component_id"] == points["id"], "left").select("entity_id", F.coalesce("to", "component_id").alias("component_id")))
        left, right = points.withColumnsRenamed({"id": "a", "to": "x"}), points.withColumnsRenamed({"id": "b", "to": "y"})
        live = held(live.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
    return found


def peeled(tasks: DataFrame, depends: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tasks by wave, as one table a wave, and the tasks in or above a cycle, which no wave reaches.

    A wave looks only at what waits for the one before: the dependencies stay where they are, and of the tasks only those
    with some dependencies done and others open are carried on.
    """
    many = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = held(tasks.select("task_id").distinct())
    known = held(depends.join(every.select(F.col("task_id").alias("depends_on")), "depends_on", "left_semi").select("task_id", "depends_on").distinct())
    asked = known.groupBy("task_id").agg(F.count(F.lit(1)).alias("asked"))
    waiting = held(known.join(asked, "task_id").repartition(many, "depends_on"))
    ready, done, partly = held(every.join(asked, "task_id", "left_anti").select("task_id", F.lit(0).alias("wave"))), [], None
    while not ready.isEmpty():
        done.append(ready)
        met = waiting.join(ready.select(F.col("task_id").alias("depends_on")), "depends_on").select("task_id", "asked", F.lit(1).cast("long").alias("met"))
        state = held((met if partly is None else met.union(partly)).groupBy("task_id", "asked").agg(F.sum("met").alias("met")))
        ready, partly = state.where("met = asked").select("task_id", F.lit(len(done)).alias("wave")), state.where("met < asked").select("task_id", "asked", "met")
    return done, every.join(reduce(DataFrame.union, done).select("task_id"), "task_id", "left_anti") if done else every


def waves(tasks: DataFrame, depends: DataFrame) -> DataFrame:
    """task_id, wave: the longest chain of dependencies below each task, from 0. depends: task_id, depends_on.

    Tasks in or above a cycle, and only they, have a null wave; dependencies on unknown tasks don't count.
    """
    done, stuck = peeled(tasks, depends)
    return reduce(DataFrame.union, [*done, stuck.select("task_id", F.lit(None).cast("int").alias("wave"))])


def cyclic(tasks: DataFrame, depends: DataFrame) -> DataFrame:
    """task_id of the tasks that are in a cycle or wait for one."""
    return peeled(tasks, depends)[1]


def incident(edges: DataFrame) -> DataFrame:
    """entity_id, edge columns and direction: each edge at both of its ends."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    out = edges.select(F.col("source").alias("entity_id"), F.col("target").alias("other_id"), *rest, F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("target").alias("entity_id"), F.col("source").alias("other_id"), *rest, F.lit("in").alias("direction")))


def known_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges both of whose ends are vertices (entity_id)."""
    ids = vertices.select("entity_id").distinct()
    return edges.join(ids.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("entity_id", "target"), "target", "left_semi")


def bounded_trace(edges: DataFrame, starts: DataFrame, depth: int = 3, fan_out: int = 10, stop: DataFrame | None = None) -> DataFrame:
    """start_id, source, target, level of the edges followed: at most fan_out targets (in order) of each entity, and none
    beyond an entity in `stop` (entity_id)."""
    first = Window.partitionBy("source").orderBy("target")
    limited = edges.select("source", "target").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= fan_out).drop("nth")
    if stop is not None:
        limited = limited.join(stop.select(F.col("entity_id").alias("source")), "source", "left_anti")
    limited = held(limited)
    frontier, out = starts.select("start_id", F.col("start_id").alias("source")), None
    for level in range(1, depth + 1):
        found = held(frontier.join(limited, "source").select("start_id", "source", "target", F.lit(level).alias("level")))
        out = found if out is None else out.union(found)
        frontier = found.select("start_id", F.col("target").alias("source")).distinct()
    return out


def valid_at(edges: DataFrame, when) -> DataFrame:
    """The edges whose interval holds `when`; open ends hold everything."""
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= when)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= when)))


def merged_vertices(vertices: DataFrame) -> DataFrame:
    """One vertex for each kind and name (case and blanks aside): first id by seq, attributes of later rows win, evidence united."""
    rows = vertices.withColumn("name", F.lower(F.trim("display_name")))
    first = rows.groupBy("kind", "name").agg(F.min_by("entity_id", "seq").alias("entity_id"))
    latest = rows.select("kind", "name", "seq", F.explode("attributes").alias("key", "value")).groupBy("kind", "name", "key").agg(F.max_by("value", "seq").alias("value"))
    maps = latest.groupBy("kind", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))
    evidence = rows.select("kind", "name", F.explode("evidence_ids").alias("e")).groupBy("kind", "name").agg(F.array_sort(F.collect_set("e")).alias("evidence_ids"))
    joined = first.join(maps, ["kind", "name"], "left").join(evidence, ["kind", "name"], "left")
    empty_map, empty = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    return joined.select("kind", "name", "entity_id", F.coalesce("attributes", empty_map).alias("attributes"), F.coalesce("evidence_ids", empty).alias("evidence_ids"))


def merge_edges(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges with their ends moved to survivors (entity_id, survivor_id); loops that come of it go."""
    left = survivors.select(F.col("entity_id").alias("source"), F.col("survivor_id").alias("new_source"))
    right = survivors.select(F.col("entity_id").alias("target"), F.col("survivor_id").alias("new_target"))
    moved = edges.join(left, "source", "left").join(right, "target", "left")
    return moved.select(F.coalesce("new_source", "source").alias("source"), F.coalesce("new_target", "target").alias("target"), *[c for c in edges.columns if c not in ("source", "target")]).where("source <> target")
