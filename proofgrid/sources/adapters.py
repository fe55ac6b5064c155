"""The given tables as the engine's records: observations, payments, graph edges, hypotheses, mappings.

Each view has a DuckDB twin in TWINS, to be put before an oracle's SELECT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

RAW = {"view": "dns.a", "click": "ip.geo", "signup": "asn.prefix", "purchase": "registry.registrant_owner", "error": "misc.updated_note"}
NAMED = {"view": "resolves_to", "click": "hosts", "signup": "registrant_of", "purchase": "same_person_as", "error": "located_at"}
CURRENCY = ("USD", "EUR", "GBP", "JPY", "")


def choose(column: str, options: dict) -> Column:
    out = F.lit(None)
    for key, value in options.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def observations(spark: SparkSession, sf_dir: str, predicates: dict = RAW) -> DataFrame:
    """subject_id, predicate, value, evidence_id (null for each tenth), source_id, observed_at, event_id."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("subject_id"), choose("event_type", predicates).alias("predicate"),
        F.floor(F.regexp_extract("props", r"([0-9]+)", 1).cast("long") / 50).cast("string").alias("value"), F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("evidence_id"),
        (F.col("event_id") % 7).alias("source_id"), F.col("ts").alias("observed_at"), "event_id",
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry a line item: tx_key, seq, entry_id, direction, amount, currency, status, state."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    customers, nations = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    direction = F.when(F.col("l_returnflag") == "R", "IN").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "DISPLAY_ONLY").otherwise("OUT")
    status = (
        F.when((direction == "IN") & (F.col("o_orderstatus") == "F"), "REFUNDED").when(direction == "IN", "PENDING")
        .when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("DISPUTED")
    )
    states = F.array(*map(F.lit, ("UNSUPPORTED_STATEMENT", "DOCUMENTED", "CORROBORATED", "DISPUTED")))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return joined.select(
        F.concat(F.lit("txref:"), F.col("l_orderkey").cast("string")).alias("tx_key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice")).alias("seq"),
        F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("entry_id"), direction.alias("direction"),
        F.when(F.col("l_quantity") != 1, cents).alias("cents"), F.element_at(F.array(*map(F.lit, CURRENCY)), (F.col("n_regionkey") % 5 + 1).cast("int")).alias("currency"), status.alias("status"),
        F.element_at(states, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("state"),
    )


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers to nations, nations to regions: source, target."""
    tag = lambda kind, column: F.concat(F.lit(kind + ":"), F.col(column).cast("string"))
    customers = read(spark, sf_dir, "customer").select(tag("customer", "c_custkey").alias("source"), tag("nation", "c_nationkey").alias("target"))
    suppliers = read(spark, sf_dir, "supplier").select(tag("supplier", "s_suppkey").alias("source"), tag("nation", "s_nationkey").alias("target"))
    nations = read(spark, sf_dir, "nation").select(tag("nation", "n_nationkey").alias("source"), tag("region", "n_regionkey").alias("target"))
    return customers.union(suppliers).union(nations)


def _case(column: str, options: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in options.items()) + " END"


def _observed(predicates: dict) -> str:
    return f"""WITH obs AS (
        SELECT user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS subject, {_case("event_type", predicates)} AS predicate,
               (regexp_extract(props, '([0-9]+)', 1)::BIGINT // 50)::VARCHAR AS value, CASE WHEN event_id % 10 <> 0 THEN event_id END AS evidence_id,
               event_id % 7 AS source_id, ts AS observed_at, event_id FROM events) """


TWINS = {
    "observations": _observed(RAW),
    "named": _observed(NAMED),
    "payments": """WITH entries AS (
        SELECT 'txref:' || l_orderkey AS tx_key, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice} AS seq,
               l_linenumber || ':' || l_partkey || ':' || l_suppkey AS entry_id,
               CASE WHEN l_returnflag = 'R' THEN 'IN' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'DISPLAY_ONLY' ELSE 'OUT' END AS direction,
               CASE WHEN l_quantity <> 1 THEN round(l_extendedprice * 100)::BIGINT END AS cents,
               (['USD', 'EUR', 'GBP', 'JPY', ''])[n_regionkey % 5 + 1] AS currency,
               CASE WHEN l_returnflag = 'R' THEN CASE o_orderstatus WHEN 'F' THEN 'REFUNDED' ELSE 'PENDING' END
                    ELSE CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'DISPUTED' END END AS status,
               (['UNSUPPORTED_STATEMENT', 'DOCUMENTED', 'CORROBORATED', 'DISPUTED'])[l_linenumber % 4 + 1] AS state
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
      ranked AS (SELECT *, list_position(['UNSUPPORTED_STATEMENT', 'DISPUTED', 'DOCUMENTED', 'CORROBORATED'], state) AS state_rank,
               list_position(['FAILED', 'REQUESTED', 'ATTEMPTED', 'PENDING', 'DISPUTED', 'REFUNDED', 'COMPLETED'], status) AS status_rank FROM entries),
      ledger AS (SELECT tx_key, arg_min(direction, seq) AS direction, arg_min(currency, seq) AS currency, max(status_rank) AS status_rank, max(state_rank) AS state_rank,
               arg_max(cents, {'r': state_rank, 's': seq}) FILTER (cents IS NOT NULL) AS cents, count(DISTINCT entry_id) AS n_evidence, count(*) - 1 AS n_suppressed
               FROM ranked GROUP BY tx_key),
      merged AS (SELECT tx_key, direction, currency, (['FAILED', 'REQUESTED', 'ATTEMPTED', 'PENDING', 'DISPUTED', 'REFUNDED', 'COMPLETED'])[status_rank] AS status,
               (['UNSUPPORTED_STATEMENT', 'DISPUTED', 'DOCUMENTED', 'CORROBORATED'])[state_rank] AS verification_state, cents, n_evidence, n_suppressed FROM ledger) """,
    "places": """WITH RECURSIVE edges AS (
        SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target FROM customer UNION ALL
        SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
      both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges) """,
}
