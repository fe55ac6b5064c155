"""Queries over ledgers, graphs, tables and timelines of orders, line items, customers, suppliers and parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analysis, graph, ledger
from ..sources.adapters import TWINS, payments, place_edges
from ..sources.tables import read

def payment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merged(payments(spark, sf_dir)).select("tx_key", "cents", "currency", "status", "verification_state", "n_evidence", "n_suppressed")


def payment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.totals(ledger.merged(payments(spark, sf_dir)))


def payment_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.buckets(ledger.merged(payments(spark, sf_dir)))


def identifier_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers, suppliers and parts as identifiers."""
    one = lambda table, kind, value, key: read(spark, sf_dir, table).select(F.lit(kind).alias("kind"), F.col(value).alias("value"), F.col(key).alias("evidence_id"))
    return ledger.identifier_intake(one("customer", "customer", "c_name", "c_custkey").union(one("supplier", "supplier", "s_name", "s_suppkey")).union(one("part", "part", "p_name", "p_partkey")))


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, customer, first and last: from the order's date to its last shipment."""
    shipped = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    orders = read(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left")
    return orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("first"), F.greatest("o_orderdate", F.coalesce("shipped", "o_orderdate")).alias("last"))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders whose intervals overlap."""
    rows = order_intervals(spark, sf_dir)
    a, b = rows.toDF("order_a", "customer", "first_a", "last_a"), rows.toDF("order_b", "customer", "first_b", "last_b")
    both = a.join(b, "customer").where("order_a < order_b AND first_a <= last_b AND first_b <= last_a")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return both.select("order_a", "order_b", day(F.greatest("first_a", "first_b")).alias("overlap_start"), day(F.least("last_a", "last_b")).alias("overlap_end"))


def edges_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order edges valid at the first of each year, by the order's status."""
    orders = order_intervals(spark, sf_dir).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("kind")), "order_id")
    starts = F.transform(F.sequence(F.year("first"), F.year("last")), lambda y: F.make_date(y, F.lit(1), F.lit(1)))
    within = F.filter(starts, lambda d: (d >= F.to_date("first")) & (d <= F.to_date("last")))
    return orders.select("kind", F.explode(within).alias("day")).groupBy(F.date_format("day", "yyyy-MM-dd").alias("as_of"), "kind").agg(F.count(F.lit(1)).alias("n_edges"))


def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(place_edges(spark, sf_dir))


def khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is within three hops of each region."""
    starts = read(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("start_id"))
    return graph.reach(place_edges(spark, sf_dir), starts, 3)


def named(kind: str, column: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def trade_edges(spark: SparkSession, sf_dir: str, tag: Callable[[str, str], Column] = named) -> DataFrame:
    """Customers to their orders, orders to the suppliers of their lines, a row for each line; graph operators take equal edges as one."""
    placed = read(spark, sf_dir, "orders").select(tag("customer", "o_custkey").alias("source"), tag("order", "o_orderkey").alias("target"))
    return placed.union(read(spark, sf_dir, "lineitem").select(tag("order", "l_orderkey"), tag("supplier", "l_suppkey")))


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from the first supplier to everything that trade connects with it; on the way entities are numbers, four times the key and the kind."""
    kinds = ("customer", "order", "supplier")
    number = lambda kind, column: F.col(column).cast("long") * 4 + kinds.index(kind)
    name = lambda column: F.concat(F.element_at(F.array(*[F.lit(f"{k}:") for k in kinds]), F.col(column).bitwiseAND(3).cast("int") + 1), F.shiftright(column, 2).cast("string"))
    start = read(spark, sf_dir, "supplier").agg(F.min("s_suppkey").alias("k")).select(number("supplier", "k").alias("start_id"))
    return graph.reach(trade_edges(spark, sf_dir, number), start).select(name("start_id").alias("src"), name("entity_id").alias("dst"), F.col("hops").alias("n_hops"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders."""
    edges = trade_edges(spark, sf_dir).where("source LIKE 'customer:%'")
    customers = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return graph.components(edges, customers.union(edges.select("target")).union(edges.select("source")).distinct())


def dag_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event depends on the events of a seventh and a tenth of its id."""
    events = read(spark, sf_dir, "events").select("event_id")
    on = lambda n: F.floor(F.col("event_id") / n)
    depends = events.where("event_id > 0").select(F.col("event_id").alias("task_id"), F.explode(F.array(on(7), on(10))).alias("depends_on"))
    return graph.waves(events.select(F.col("event_id").alias("task_id")), depends)


def bounded_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order flow from each region: three levels down, ten targets each, not beyond nations of no customers."""
    edges = place_edges(spark, sf_dir).select(F.col("target").alias("source"), F.col("source").alias("target"))
    starts = read(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("start_id"))
    return graph.bounded_trace(edges, starts)


def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.schema_profile(read(spark, sf_dir, "part"), "part").unionByName(analysis.schema_profile(read(spark, sf_dir, "customer").drop("c_acctbal"), "customer"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order status within 1995 to 1997, and within 1996 to 1998."""
    orders = read(spark, sf_dir, "orders")
    snap = lambda low, high: orders.where((F.year("o_orderdate") >= low) & (F.year("o_orderdate") <= high)).groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("value"))
    return analysis.snapshot_diff(snap(1995, 1997), snap(1996, 1998))


def er_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of equal brand, type and size, compared by name."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand", "p_type", "p_size")
    return analysis.er_pairs(parts, ["p_brand", "p_type", "p_size"])


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with coordinates derived from their keys."""
    key = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(key.cast("long").alias("nation_id"), ((key * 37) % 140 - 70).cast("double").alias("lat"), ((key * 73) % 360 - 180).cast("double").alias("lon"))


def competing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share two parts or more of the same order: hypotheses that share entities."""
    lines = read(spark, sf_dir, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), (F.col("l_partkey") % 3).cast("string")).alias("entity"), F.col("l_suppkey").alias("h")).distinct()
    a, b = lines.toDF("entity", "left_id"), lines.toDF("entity", "right_id")
    return a.join(b, "entity").where("left_id < right_id").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n_shared")).where("n_shared >= 2")


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand and type with totals."""
    return read(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most valuable orders of each customer: ranking with ties by key."""
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(order).alias("place")).where("place <= 3")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done over total orders by priority."""
    rows = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("ratio", F.round(F.col("done") / F.col("total"), 3))


_PLACES = TWINS["places"]
QUERIES = {
    f.__name__: f
    for f in (
        payment_dedup, payment_totals, payment_buckets, identifier_intake, interval_overlap, edges_at_time, graph_neighbors, khop, shortest_path, connected_components, dag_waves, bounded_trace, schema_profile, snapshot_diff,
        er_pairs, competing_pairs, category_rollup, top_orders, progress,
    )
}
_PROFILE = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c}::VARCHAR AS value FROM {t}"
    for t, columns in (("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")), ("customer", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
    for c in columns
)
_INTERVALS = """WITH i AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS kind, o_orderdate AS f, greatest(o_orderdate, coalesce(max(l_shipdate), o_orderdate)) AS l
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderstatus, o_orderdate) """
ORACLES = {
    "payment_dedup": TWINS["payments"] + "SELECT tx_key, cents, currency, status, verification_state, n_evidence, n_suppressed FROM merged",
    "payment_totals": TWINS["payments"]
    + """, t AS (SELECT *, direction = 'OUT' AND status = 'COMPLETED' AS o, direction = 'IN' AND status = 'REFUNDED' AS i FROM merged WHERE verification_state <> 'UNSUPPORTED_STATEMENT')
        SELECT currency, coalesce(sum(CASE WHEN o AND currency <> '' THEN cents END), 0)::BIGINT AS outflow, coalesce(sum(CASE WHEN i AND currency <> '' THEN cents END), 0)::BIGINT AS returns,
        count_if(o AND cents IS NULL)::BIGINT AS unknown_amount_out, count_if(o AND cents IS NOT NULL AND currency = '')::BIGINT AS unknown_currency_out,
        count_if(i AND cents IS NULL)::BIGINT AS unknown_amount_in, count_if(i AND cents IS NOT NULL AND currency = '')::BIGINT AS unknown_currency_in,
        (coalesce(sum(CASE WHEN o AND currency <> '' THEN cents END), 0) - coalesce(sum(CASE WHEN i AND currency <> '' THEN cents END), 0))::BIGINT AS provisional_net_loss FROM t GROUP BY currency""",
    "payment_buckets": TWINS["payments"] + "SELECT status, count(*) AS n_entries, coalesce(sum(cents), 0)::BIGINT AS cents FROM merged WHERE status IN ('PENDING', 'DISPUTED', 'ATTEMPTED', 'REQUESTED', 'FAILED') GROUP BY status",
    "identifier_intake": """SELECT kind, lower(trim(value)) AS value, count(DISTINCT id) AS n_evidence, 'OBSERVED_IDENTIFIER' AS level FROM (SELECT 'customer' AS kind, c_name AS value, c_custkey AS id FROM customer
        UNION ALL SELECT 'supplier', s_name, s_suppkey FROM supplier UNION ALL SELECT 'part', p_name, p_partkey FROM part) GROUP BY 1, 2""",
    "interval_overlap": _INTERVALS
    + """SELECT a.id AS order_a, b.id AS order_b, strftime(greatest(a.f, b.f), '%Y-%m-%d') AS overlap_start, strftime(least(a.l, b.l), '%Y-%m-%d') AS overlap_end
        FROM i a JOIN i b ON a.cust = b.cust AND a.id < b.id AND a.f <= b.l AND b.f <= a.l""",
    "edges_at_time": _INTERVALS + """, y AS (SELECT kind, f, l, unnest(range(year(f), year(l) + 1)) AS y FROM i)
        SELECT y || '-01-01' AS as_of, kind, count(*) AS n_edges FROM y WHERE make_date(y, 1, 1) BETWEEN f::DATE AND l::DATE GROUP BY 1, 2""",
    "graph_neighbors": _PLACES + "SELECT a AS entity_id, b AS neighbor_id, split_part(b, ':', 1) AS neighbor_kind FROM both_ways",
    "khop": _PLACES + """, r AS (SELECT 'region:' || r_regionkey AS start_id, 'region:' || r_regionkey AS entity_id, 0 AS hops FROM region
        UNION SELECT start_id, b, hops + 1 FROM r JOIN both_ways ON entity_id = a WHERE hops < 3) SELECT start_id, entity_id, min(hops) AS hops FROM r GROUP BY 1, 2""",
    "shortest_path": """WITH RECURSIVE e AS (SELECT 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b FROM orders UNION SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem),
        g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT 'supplier:' || min(s_suppkey) AS src, 'supplier:' || min(s_suppkey) AS dst, 0 AS n FROM supplier UNION SELECT src, b, n + 1 FROM r JOIN g ON dst = a WHERE n < 8)
        SELECT src, dst, min(n) AS n_hops FROM r GROUP BY 1, 2""",
    "connected_components": """SELECT 'customer:' || c_custkey AS entity_id, 'customer:' || c_custkey AS component_id FROM customer UNION SELECT 'customer:' || o_custkey, 'customer:' || o_custkey FROM orders
        UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders""",
    "dag_waves": """WITH RECURSIVE d AS (SELECT event_id AS t, unnest([event_id // 7, event_id // 10]) AS p FROM events WHERE event_id > 0), r AS (SELECT event_id AS task_id, 0 AS wave FROM events
        UNION SELECT t, wave + 1 FROM r JOIN d ON task_id = p) SELECT task_id, max(wave) AS wave FROM r GROUP BY 1""",
    "bounded_trace": _PLACES + """, k AS (SELECT target AS source, source AS target, row_number() OVER (PARTITION BY target ORDER BY source) AS nth FROM (SELECT DISTINCT * FROM edges)),
        t AS (SELECT source AS start_id, source, target, 1 AS level FROM k WHERE nth <= 10 AND source LIKE 'region:%'
        UNION SELECT t.start_id, k.source, k.target, level + 1 FROM t JOIN k ON t.target = k.source AND nth <= 10 WHERE level < 3) SELECT * FROM t""",
    "schema_profile": f"""WITH c AS ({_PROFILE}), s AS (SELECT table_name, column_name, count(*) AS n, count(DISTINCT trim(value)) AS d, {", ".join(f"count_if(regexp_matches(trim(value), '{p}')) AS {t}" for t, p in analysis.TAGS.items())} FROM c GROUP BY 1, 2)
        SELECT table_name, column_name, CASE {" ".join(f"WHEN {t} >= 0.8 * n THEN '{t if t in ('integer', 'float', 'timestamp') else 'string'}'" for t in analysis.TAGS)} ELSE 'string' END AS inferred_type, false AS nullable,
        round(d / n, 6) AS unique_ratio, round(d / n, 6) >= 0.99 AS is_candidate_key FROM s""",
    "snapshot_diff": """WITH s AS (SELECT o_custkey AS key, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) FILTER (year(o_orderdate) BETWEEN 1995 AND 1997) AS old_value,
        arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) FILTER (year(o_orderdate) BETWEEN 1996 AND 1998) AS new_value FROM orders GROUP BY 1)
        SELECT key, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change_kind, old_value, new_value FROM s WHERE old_value IS DISTINCT FROM new_value""",
    "competing_pairs": """WITH x AS (SELECT DISTINCT l_orderkey || ':' || (l_partkey % 3) AS e, l_suppkey AS h FROM lineitem)
        SELECT a.h AS left_id, b.h AS right_id, count(*) AS n_shared FROM x a JOIN x b ON a.e = b.e AND a.h < b.h GROUP BY 1, 2 HAVING count(*) >= 2""",
    "category_rollup": "SELECT p_brand, p_type, count(*) AS n, grouping(p_brand, p_type)::INTEGER AS level FROM part GROUP BY ROLLUP (p_brand, p_type)",
    "top_orders": "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 3",
    "progress": "SELECT o_orderpriority, count_if(o_orderstatus = 'F')::BIGINT AS done, count(*) AS total, round(count_if(o_orderstatus = 'F')::DOUBLE / count(*), 3) AS ratio FROM orders GROUP BY 1",
}
