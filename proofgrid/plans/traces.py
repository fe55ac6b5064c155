"""Queries of budgeted traces: goods from each supplier through parts to other suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trace
from ..sources.tables import read


def budgeted_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier: its parts, their suppliers and so on; small parts are boundaries, a price ending in 9 isn't valid."""
    lines = read(spark, sf_dir, "lineitem")
    supplier, part = F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")), F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    edges = lines.select(supplier.alias("source"), part.alias("target")).union(lines.select(part, supplier))
    starts = read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("start_id"))
    small = read(spark, sf_dir, "part").where("p_size <= 5").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("address"), F.concat(F.lit("small "), "p_brand").alias("label"))
    return trace.budgeted_trace(edges, starts, small, ~F.col("address").rlike("^part:[0-9]*9$"))


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.trace_summary(budgeted_trace(spark, sf_dir))


QUERIES = {f.__name__: f for f in (budgeted_trace, trace_summary)}

_TRACE = """WITH RECURSIVE e AS (SELECT DISTINCT 'supplier:' || l_suppkey AS source, 'part:' || l_partkey AS target FROM lineitem UNION SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem),
      near AS (SELECT source, target, lpad((row_number() OVER (PARTITION BY source ORDER BY target) - 1)::VARCHAR, 2, '0') AS step FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY target) <= 10),
      labels AS (SELECT 'part:' || p_partkey AS address, 'small ' || p_brand AS label FROM part WHERE p_size <= 5),
      walk AS (
        SELECT 'supplier:' || s_suppkey AS start_id, '' AS path, 0 AS depth, 'supplier:' || s_suppkey AS address, 'visited' AS outcome FROM supplier
        UNION ALL
        SELECT start_id, path || step, depth + 1, target, CASE WHEN depth = 3 THEN 'too_deep' WHEN regexp_matches(target, '^part:[0-9]*9$') THEN 'invalid' WHEN target IN (SELECT address FROM labels) THEN 'boundary' ELSE 'visited' END
        FROM walk JOIN near ON source = address WHERE outcome = 'visited'),
      numbered AS (SELECT *, CASE WHEN outcome = 'visited' THEN count(*) FILTER (outcome = 'visited') OVER (PARTITION BY start_id ORDER BY path) END AS call_no FROM walk),
      trace AS (SELECT n.start_id, n.path, n.depth, n.address, CASE WHEN n.call_no > 25 THEN 'budget' ELSE n.outcome END AS outcome, CASE WHEN n.outcome = 'boundary' THEN label END AS label, CASE WHEN n.call_no <= 25 THEN n.call_no END AS call_no
        FROM numbered n LEFT JOIN labels USING (address) WHERE n.path = '' OR EXISTS (SELECT 1 FROM numbered p WHERE p.start_id = n.start_id AND p.path = left(n.path, length(n.path) - 2) AND p.call_no <= 25)) """
ORACLES = {
    "budgeted_trace": f"{_TRACE} SELECT * FROM trace",
    "trace_summary": f"""{_TRACE} SELECT start_id, count_if(outcome = 'visited')::BIGINT AS calls, count_if(outcome IN ('visited', 'budget'))::BIGINT AS n_visited, count_if(outcome = 'boundary')::BIGINT AS n_boundaries,
        count_if(outcome = 'budget')::BIGINT AS n_left, count_if(outcome = 'too_deep')::BIGINT AS n_too_deep FROM trace GROUP BY start_id""",
}
