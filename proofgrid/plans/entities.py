"""Queries over entities: observations of the events table as domains, addresses, registrars and name servers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import graph, matching
from ..sources.adapters import place_edges
from ..sources.tables import read


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: a user's domain (each third is an address) and what was seen of it."""
    u, e, k = F.col("user_id"), F.col("event_id"), F.floor(F.col("value") / 20)
    text = lambda c: c.cast("string")
    subject = F.when(u % 3 == 0, F.concat(F.lit("10.0."), text(u % 256), F.lit(".1"))).otherwise(F.concat(F.lit(" Host"), text(u), F.lit(".example.org")))
    predicate = F.when(F.col("event_type") == "view", "dns.a").when(F.col("event_type") == "click", "dns.cname").when(F.col("event_type") == "signup", "domain.subdomain_seen_in_ct").when(F.col("event_type") == "purchase", "registrar").otherwise(F.when(e % 2 == 0, "domain.nameserver").otherwise("ip.organization"))
    value = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("192.0.2."), text(k))).when(F.col("event_type") == "click", F.concat(F.lit("www.cdn"), text(k), F.lit(".example.net."))).when(F.col("event_type") == "signup", F.concat(F.lit("Host"), text(u - k % 2), F.lit(".example.org")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Registrar  No."), text(k % 5))).otherwise(F.concat(F.lit("NS"), text(k % 7), F.lit(".example.com.")))
    )
    return read(spark, sf_dir, "events").select(subject.alias("subject"), predicate.alias("predicate"), value.alias("value"), F.when(e % 10 != 0, e).alias("evidence_id"))


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.typed_edges(sightings(spark, sf_dir))


def entity_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.typed_vertices(sightings(spark, sf_dir))


def collected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.collected_edges(sightings(spark, sf_dir))


def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ask for host names, some of which were never seen."""
    k = F.col("s_suppkey")
    wanted = read(spark, sf_dir, "supplier").select(k.alias("query_id"), F.lit("domain").alias("kind"), F.concat(F.lit("WWW.Host"), (k * 2).cast("string"), F.lit(".Example.org.")).alias("value"))
    return E.looked_up(E.typed_vertices(sightings(spark, sf_dir)), wanted)


def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges at each entity that has three pieces of evidence or more, from edges whose both ends do."""
    obs = sightings(spark, sf_dir)
    key = lambda kind, name: F.concat_ws(":", kind, name)
    well = E.typed_vertices(obs).where("n_evidence >= 3").select(key("kind", "name").alias("entity_id"))
    edges = E.typed_edges(obs).select(key("source_kind", "source").alias("source"), key("target_kind", "target").alias("target"), "kind")
    return graph.incident(graph.known_edges(edges, well))


def shortest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest way from the first region to everything of the place graph."""
    rows = graph.routes(place_edges(spark, sf_dir), "region:0")
    return rows.select("entity_id", "hops", F.array_join("route", " > ").alias("route"))


def cyclic_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event waits for that of half its id; each 97th also for that of twice its id, and so waits for itself."""
    e = F.col("event_id")
    events = read(spark, sf_dir, "events").select(e.alias("task_id"))
    half = events.where("task_id > 0").select("task_id", F.floor(F.col("task_id") / 2).alias("depends_on"))
    twice = events.where("task_id > 0 AND task_id % 97 = 0").select("task_id", (F.col("task_id") * 2).alias("depends_on"))
    return graph.cyclic(events, half.union(twice))


def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand, kind and size as organisations, with their price class as an attribute."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("organization").alias("kind"), F.col("p_name").alias("name"), (F.col("p_partkey") % 3).alias("n_evidence"), "p_brand", "p_type", "p_size", F.floor(F.col("p_retailprice") / 50).alias("price_class"))
    return E.matched_pairs(rows, ["p_brand", "p_type", "p_size"], ["price_class"])


def alike_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand whose names are at least possible matches."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand")
    return matching.alike(rows, ["p_brand"], 0.85)


QUERIES = {f.__name__: f for f in (alike_parts, entity_edges, entity_vertices, collected_edges, entity_lookup, incident_edges, shortest_routes, cyclic_tasks, entity_pairs)}

_OBS = """WITH o AS (SELECT lower(trim(CASE WHEN user_id % 3 = 0 THEN '10.0.' || (user_id % 256) || '.1' ELSE ' Host' || user_id || '.example.org' END)) AS subject,
    CASE event_type WHEN 'view' THEN 'dns.a' WHEN 'click' THEN 'dns.cname' WHEN 'signup' THEN 'domain.subdomain_seen_in_ct' WHEN 'purchase' THEN 'registrar' ELSE CASE WHEN event_id % 2 = 0 THEN 'domain.nameserver' ELSE 'ip.organization' END END AS predicate, floor(value / 20)::BIGINT AS k,
    user_id, event_type, CASE WHEN event_id % 10 <> 0 THEN event_id END AS evidence_id FROM events),
  v AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'ip_address' ELSE 'domain' END AS source_kind, CASE predicate WHEN 'dns.a' THEN 'ip_address' WHEN 'registrar' THEN 'organization' WHEN 'ip.organization' THEN NULL ELSE 'domain' END AS target_kind,
    CASE event_type WHEN 'view' THEN '192.0.2.' || k WHEN 'click' THEN 'cdn' || k || '.example.net' WHEN 'signup' THEN 'host' || (user_id - k % 2) || '.example.org' WHEN 'purchase' THEN 'registrar no ' || (k % 5) ELSE CASE WHEN predicate = 'ip.organization' THEN 'ns' || (k % 7) || ' example com' ELSE 'ns' || (k % 7) || '.example.com' END END AS target FROM o),
  ed AS (SELECT source_kind, subject AS source, target_kind, target, CASE WHEN target_kind = 'ip_address' THEN 'resolves_to' WHEN predicate = 'domain.nameserver' THEN 'hosts' ELSE 'related_to' END AS kind, count(DISTINCT evidence_id) AS n_evidence FROM v WHERE target_kind IS NOT NULL GROUP BY ALL),
  ve AS (SELECT kind, name, count(DISTINCT evidence_id) AS n_evidence FROM (SELECT source_kind AS kind, subject AS name, evidence_id FROM v UNION ALL SELECT target_kind, target, evidence_id FROM v WHERE target_kind IS NOT NULL) GROUP BY 1, 2) """
ORACLES = {
    "entity_edges": _OBS + "SELECT * FROM ed",
    "entity_vertices": _OBS + "SELECT * FROM ve",
    "collected_edges": _OBS + """SELECT subject AS source, CASE predicate WHEN 'dns.a' THEN 'resolves_to' WHEN 'ip.organization' THEN 'operated_by' ELSE 'issued_for' END AS kind, CASE predicate WHEN 'dns.a' THEN 'ip_address' WHEN 'ip.organization' THEN 'organization' ELSE 'domain' END AS target_kind,
        target, count(DISTINCT evidence_id) AS n_evidence FROM v WHERE evidence_id IS NOT NULL AND predicate IN ('dns.a', 'ip.organization', 'domain.subdomain_seen_in_ct') AND target <> subject GROUP BY ALL""",
    "entity_lookup": _OBS + "SELECT s_suppkey AS query_id, 'domain' AS kind, 'host' || s_suppkey * 2 || '.example.org' AS name, n_evidence FROM supplier LEFT JOIN ve ON ve.kind = 'domain' AND ve.name = 'host' || s_suppkey * 2 || '.example.org'",
    "incident_edges": _OBS + """, w AS (SELECT kind || ':' || name AS id FROM ve WHERE n_evidence >= 3), k AS (SELECT source_kind || ':' || source AS s, target_kind || ':' || target AS t, kind FROM ed), g AS (SELECT * FROM k WHERE s IN (SELECT id FROM w) AND t IN (SELECT id FROM w))
        SELECT s AS entity_id, t AS other_id, kind, 'out' AS direction FROM g UNION ALL SELECT t, s, kind, 'in' FROM g""",
    "shortest_routes": """WITH RECURSIVE e AS (SELECT 'customer:' || c_custkey AS a, 'nation:' || c_nationkey AS b FROM customer UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
        g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT 'region:0' AS id, 0 AS hops, 'region:0' AS route UNION SELECT b, hops + 1, route || ' > ' || b FROM r JOIN g ON id = a WHERE hops < 4 AND NOT contains(' > ' || route || ' > ', ' > ' || b || ' > '))
        SELECT id AS entity_id, min(hops) AS hops, arg_min(route, {'h': hops, 'r': route}) AS route FROM r GROUP BY 1""",
    "cyclic_tasks": """WITH RECURSIVE n AS (SELECT max(event_id) AS most FROM events), r AS (SELECT event_id AS t FROM events, n WHERE event_id > 0 AND event_id % 97 = 0 AND event_id * 2 <= most UNION SELECT event_id FROM events JOIN r ON event_id > 0 AND event_id // 2 = t) SELECT t AS task_id FROM r""",
}
