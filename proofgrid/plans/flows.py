"""Queries over states, plans, budgets, feeds, evidence, paragraphs and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scoring import confidence_band, next_action_priority
from ..operators import graph, state
from ..sources import tables
from ..sources.adapters import place_edges
from ..sources.tables import read
from ..streaming import watch

ASKED = ("active", "testing", "strengthened", "weakened", "supported", "disputed", "falsified", "inconclusive", "archived")


def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as hypotheses; each event asks for a state by its id, and one in forty may archive."""
    asked = F.when(F.col("event_id") % 41 == 0, "archived").otherwise(F.element_at(F.array(*map(F.lit, ASKED[:-1])), (F.col("event_id") % 8 + 1).cast("int")))
    events = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", asked.alias("asked"))
    return state.folded(events, "user_id", "day", "event_id", "asked", "proposed")


def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tasks, done from a value of 30; each depends on those of a seventh and a tenth of its id."""
    events = read(spark, sf_dir, "events")
    depends = events.where("event_id > 0").select(F.col("event_id").alias("task_id"), F.explode(F.array(F.floor(F.col("event_id") / 7), F.floor(F.col("event_id") / 10))).alias("depends_on"))
    return state.ready(events.select(F.col("event_id").alias("task_id"), (F.col("value") >= 30).alias("done")), depends)


def plan_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import dag_waves

    return state.plan_minutes(dag_waves(spark, sf_dir))


def budget_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as entries of their order's reservations by part group: held, committed, refunded."""
    kind = F.when(F.col("l_returnflag") == "R", "refund").when(F.col("l_linestatus") == "F", "commit").otherwise("hold")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    entries = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.concat_ws(":", F.col("l_orderkey").cast("string"), (F.col("l_partkey") % 3).cast("string")).alias("reservation_id"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("seq"), kind.alias("kind"), cents.alias("amount"))
    return state.budget_snapshot(entries)


def majority_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.majority(read(spark, sf_dir, "events"), ["user_id"], "event_type")


def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best actions of each customer: gain by price, cost by lines, risk by priority."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    risk = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").when(F.col("o_orderpriority").startswith("3"), "low").otherwise("none")
    scored = orders.join(lines, "o_orderkey", "left").select("o_custkey", "o_orderkey", F.round(next_action_priority(F.least(F.lit(1.0), F.col("o_totalprice") / 500000), F.coalesce("n", F.lit(0)) / 4, risk, F.col("o_orderstatus") == "P"), 8).alias("priority"))
    return state.top(scored, ["o_custkey"], [F.col("priority").desc(), F.col("o_orderkey").asc()], 3)


def watch_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over events: errors of value 50 or more alert once for each user and day."""
    items = watch.feed(spark, sf_dir, "events")
    story = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    stream = watch.alerts(items, "errors", (F.col("event_type") == "error") & (F.col("value") >= 50), story)
    return watch.run(stream, watch.folder(spark, "alerts"), watch.folder(spark, "alerts-state"))


def evidence_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence: hash and size of the bytes, and the first id with the same."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")).select("doc_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size_bytes"))
    first = rows.groupBy("sha256").agg(F.min("doc_id").alias("storage_key"))
    return rows.join(first, "sha256").select("doc_id", "sha256", "size_bytes", "storage_key")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return tables.keep_last(rows, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return tables.paragraphs(lines, 10).select("doc_id", "first_line", "last_line", F.length("text").alias("n_chars"))


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value lines of conversations and documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return tables.key_values(docs)


def json_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each event's properties by JSON pointer."""
    found = F.explode(F.map_entries(F.from_json("props", "map<string,string>")))
    return read(spark, sf_dir, "events").select("event_id", found.alias("e")).select("event_id", F.concat(F.lit("/"), F.replace(F.replace(F.col("e.key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).alias("pointer"), F.col("e.value").alias("value"))


def delimiter_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delimiter that occurs most in each document, if any does."""
    text = F.coalesce("text", F.lit(""))
    counts = [F.struct((F.length(text) - F.length(F.replace(text, F.lit(d)))).alias("n"), F.lit(-k).alias("turn"), F.lit(name).alias("name")) for k, (d, name) in enumerate(((",", "comma"), ("\t", "tab"), ("|", "pipe"), (";", "semicolon")))]
    return read(spark, sf_dir, "documents").select("doc_id", F.array_max(F.array(*counts)).alias("b")).select("doc_id", F.when(F.col("b.n") > 0, F.col("b.name")).alias("delimiter"), F.col("b.n").alias("n"))


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages with their four URL variants."""
    host = F.regexp_extract("url", r"^https?://(?:www\.)?([^/]+)", 1)
    hosts = read(spark, sf_dir, "pages").select(host.alias("domain")).where("domain <> ''").distinct()
    return hosts.select("domain", F.explode(F.array(*[F.concat(F.lit(p), F.col("domain")) for p in ("http://", "https://", "http://www.", "https://www.")])).alias("url"))


def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding box and centre of each region's places."""
    from .records import places

    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation_id"), "n_regionkey")
    return places(spark, sf_dir).join(nations, "nation_id").groupBy("n_regionkey").agg(
        *[F.min(c).alias(f"min_{c}") for c in ("lat", "lon")], *[F.max(c).alias(f"max_{c}") for c in ("lat", "lon")], *[F.round(F.avg(c), 6).alias(f"mid_{c}") for c in ("lat", "lon")]
    )


def sun_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sun elevation and shadow at each event, users placed by their id."""
    lat, lon = ((F.col("user_id") * 37) % 120 - 60).cast("double"), ((F.col("user_id") * 73) % 360 - 180).cast("double")
    elevation = F.round(geo.sun_elevation(F.col("ts"), lat, lon), 4)
    return read(spark, sf_dir, "events").select("event_id", elevation.alias("elevation")).withColumn("shadow", F.round(geo.shadow_factor(F.col("elevation")), 3))


def endpoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a known customer, and lines without a known order, part or supplier."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    missing = lambda rows, key, table, other, kind: rows.join(read(spark, sf_dir, table), rows[key] == F.col(other), "left_anti").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_dangling"))
    return missing(orders, "o_custkey", "customer", "c_custkey", "order-customer").union(missing(lines, "l_orderkey", "orders", "o_orderkey", "line-order")).union(missing(lines, "l_partkey", "part", "p_partkey", "line-part")).union(missing(lines, "l_suppkey", "supplier", "s_suppkey", "line-supplier"))


def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of equal name as one vertex, and how many supply edges move to it."""
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.lower(F.trim("p_name")).alias("name"))
    survivors = names.join(names.groupBy("name").agg(F.min("entity_id").alias("survivor_id")), "name").select("entity_id", "survivor_id")
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), (-F.col("l_suppkey") - 1).alias("target"))
    moved = graph.merge_edges(edges, survivors)
    return moved.groupBy(F.col("source").alias("part_id")).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("target").alias("n_suppliers"))


def source_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors (users) by the distinct sources that attribute to them, with a band of the mean value."""
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("event_id") % 7)).alias("n_sources"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count(F.lit(1)) / 10000, 4).alias("mean"))
    level = F.when(F.col("n_sources") >= 2, "multi_source").when(F.col("n_sources") == 1, "single_source").otherwise("unattributed")
    return rows.select("user_id", "n_sources", level.alias("level"), confidence_band(F.col("mean")).alias("band"))


def place_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices and incident edges of the place graph by kind."""
    both = graph.undirected(place_edges(spark, sf_dir))
    return both.groupBy(F.substring_index("a", ":", 1).alias("kind")).agg(F.countDistinct("a").alias("n_vertices"), F.count(F.lit(1)).alias("n_edges"))


def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by scheme, extension of the path and whether a query or fragment follows."""
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"^(https?):", 1).alias("scheme"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.col("url").rlike(r"\?").alias("has_query"), F.col("url").rlike("#").alias("has_fragment")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        lifecycle_states, ready_tasks, plan_latency, budget_snapshot, majority_tag, next_actions, watch_alerts, evidence_registry, latest_events, doc_paragraphs, key_values, json_pointers, delimiter_sniff, url_variants, region_boxes,
        sun_positions, endpoint_check, merged_parts, source_attribution, place_degrees, media_types,
    )
}

_WAVES = """WITH RECURSIVE d AS (SELECT event_id AS t, unnest([event_id // 7, event_id // 10]) AS p FROM events WHERE event_id > 0), r AS (SELECT event_id AS task_id, 0 AS wave FROM events
    UNION SELECT t, wave + 1 FROM r JOIN d ON task_id = p), w AS (SELECT task_id, max(wave) AS wave FROM r GROUP BY 1) """
_AFTER = "CASE s " + " ".join(f"WHEN '{s}' THEN CASE WHEN asked IN {after if len(after) > 1 else '(' + repr(after[0]) + ')'} THEN asked ELSE s END" for s, after in state.LIFECYCLE.items() if after) + " ELSE s END"
_LAT, _LON = "((user_id * 37) % 120 - 60)::DOUBLE", "((user_id * 73) % 360 - 180)::DOUBLE"
ORACLES = {
    "lifecycle_states": f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id) AS k, CASE WHEN event_id % 41 = 0 THEN 'archived' ELSE ({list(ASKED[:-1])})[event_id % 8 + 1] END AS asked FROM events),
        r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'proposed' AS s FROM events UNION ALL SELECT r.user_id, e.k, {_AFTER} FROM r JOIN e ON r.user_id = e.user_id AND e.k = r.k + 1)
        SELECT user_id, arg_max(s, k) AS state, max(k) AS n_events FROM r GROUP BY 1""",
    "ready_tasks": """WITH d AS (SELECT event_id AS t, unnest([event_id // 7, event_id // 10]) AS p FROM events WHERE event_id > 0)
        SELECT event_id AS task_id FROM events WHERE value < 30 AND event_id NOT IN (SELECT t FROM d JOIN events ON p = event_id WHERE value < 30)""",
    "plan_latency": _WAVES + "SELECT sum(n)::BIGINT AS tasks, count(*) AS waves, round(sum(greatest(1, n // 4)) * 8.0::DOUBLE / 60, 2)::DOUBLE AS minutes FROM (SELECT wave, count(*) AS n FROM w GROUP BY 1)",
    "budget_snapshot": """WITH e AS (SELECT l_suppkey AS key, l_orderkey || ':' || (l_partkey % 3) AS rid, {'a': l_linenumber, 'b': l_partkey, 'c': l_extendedprice} AS seq,
        CASE WHEN l_returnflag = 'R' THEN 'refund' WHEN l_linestatus = 'F' THEN 'commit' ELSE 'hold' END AS kind, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem),
        l AS (SELECT key, rid, arg_max(kind, seq) AS kind, arg_max(cents, seq) AS cents FROM e GROUP BY 1, 2)
        SELECT key, coalesce(sum(cents) FILTER (kind = 'commit'), 0)::BIGINT AS spent, coalesce(sum(cents) FILTER (kind = 'hold'), 0)::BIGINT AS held, coalesce(sum(cents) FILTER (kind = 'refund'), 0)::BIGINT AS refunded FROM l GROUP BY 1""",
    "majority_tag": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, arg_min(event_type, {'a': -n, 'b': event_type}) AS majority, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM c GROUP BY 1""",
    "next_actions": """WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT o_custkey, o_orderkey,
        round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, o_totalprice / 500000) - least(1.0::DOUBLE, coalesce(n, 0) / 4.0::DOUBLE / 5.0) - (CASE left(o_orderpriority, 1) WHEN '1' THEN 0.5 WHEN '2' THEN 0.2 WHEN '3' THEN 0.05 ELSE 0.0 END)::DOUBLE
          - (CASE WHEN o_orderstatus = 'P' THEN 0.15 ELSE 0.0 END)::DOUBLE), 8) AS priority FROM orders LEFT JOIN n ON o_orderkey = k)
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY priority DESC, o_orderkey)::INTEGER AS place FROM s QUALIFY place <= 3""",
    "watch_alerts": """SELECT DISTINCT 'errors' AS rule_id, user_id || ':' || strftime(ts, '%Y-%m-%d') AS story_key, 'alrt-' || left(sha256('errors' || user_id || ':' || strftime(ts, '%Y-%m-%d')), 10) AS alert_id
        FROM events WHERE event_type = 'error' AND value >= 50""",
    "evidence_registry": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, '')))::INTEGER AS size_bytes, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS storage_key FROM documents",
    "latest_events": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "doc_paragraphs": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
        b AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM l), f AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, block ORDER BY line_no) - 1) // 10 AS part FROM b WHERE trim(line) <> '')
        SELECT doc_id, min(line_no)::INTEGER AS first_line, max(line_no)::INTEGER AS last_line, (sum(length(line)) + count(*) - 1)::INTEGER AS n_chars FROM f GROUP BY doc_id, block, part""",
    "json_pointers": "SELECT event_id, '/k' AS pointer, regexp_extract(props, '([0-9]+)', 1) AS value FROM events",
    "delimiter_sniff": """WITH c AS (SELECT doc_id, list_max([{'n': length(text) - length(replace(text, ',', '')), 't': 0, 'd': 'comma'}, {'n': length(text) - length(replace(text, chr(9), '')), 't': -1, 'd': 'tab'},
        {'n': length(text) - length(replace(text, '|', '')), 't': -2, 'd': 'pipe'}, {'n': length(text) - length(replace(text, ';', '')), 't': -3, 'd': 'semicolon'}]) AS b FROM documents)
        SELECT doc_id, CASE WHEN b.n > 0 THEN b.d END AS delimiter, b.n::INTEGER AS n FROM c""",
    "url_variants": r"""WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://(?:www\.)?([^/]+)', 1) AS domain FROM pages) SELECT domain, unnest(['http://' || domain, 'https://' || domain, 'http://www.' || domain, 'https://www.' || domain]) AS url FROM h WHERE domain <> ''""",
    "region_boxes": """WITH p AS (SELECT n_regionkey, ((n_nationkey * 37) % 140 - 70)::DOUBLE AS lat, ((n_nationkey * 73) % 360 - 180)::DOUBLE AS lon FROM nation)
        SELECT n_regionkey, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon, round(avg(lat), 6) AS mid_lat, round(avg(lon), 6) AS mid_lon FROM p GROUP BY 1""",
    "sun_positions": f"""WITH a AS (SELECT event_id, {_LAT} AS lat, {_LON} AS lon, hour(ts) + minute(ts) / 60.0::DOUBLE AS h, radians(360.0::DOUBLE / 365.0 * (dayofyear(ts) - 81)) AS b FROM events),
        s AS (SELECT event_id, lat, radians(23.45::DOUBLE * sin(b)) AS d, radians(15 * (h - 12) + lon + (9.87::DOUBLE * sin(2 * b) - 7.53::DOUBLE * cos(b) - 1.5::DOUBLE * sin(b)) / 4) AS w FROM a),
        e AS (SELECT event_id, round(degrees(asin(sin(radians(lat)) * sin(d) + cos(radians(lat)) * cos(d) * cos(w))), 4) AS elevation FROM s)
        SELECT event_id, elevation, CASE WHEN elevation > 0.5 THEN round(1 / tan(radians(elevation)), 3) END AS shadow FROM e""",
    "endpoint_check": """SELECT 'order-customer' AS kind, count(*) AS n_dangling FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'line-order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'line-part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'line-supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "merged_parts": """WITH s AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(trim(p_name))) AS k FROM part)
        SELECT coalesce(k, l_partkey) AS part_id, count(*) AS n_edges, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem LEFT JOIN s ON l_partkey = p_partkey GROUP BY 1""",
    "source_attribution": """WITH u AS (SELECT user_id, count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id % 7 END) AS n_sources, round(sum(round(value * 100)::BIGINT)::DOUBLE / count(*) / 10000, 4) AS mean FROM events GROUP BY 1)
        SELECT user_id, n_sources, CASE WHEN n_sources >= 2 THEN 'multi_source' WHEN n_sources = 1 THEN 'single_source' ELSE 'unattributed' END AS level,
        CASE WHEN mean < 0.2 THEN 'very_low' WHEN mean < 0.45 THEN 'low' WHEN mean < 0.7 THEN 'moderate' WHEN mean < 0.9 THEN 'high' ELSE 'very_high' END AS band FROM u""",
    "place_degrees": """WITH e AS (SELECT 'customer:' || c_custkey AS s, 'nation:' || c_nationkey AS t FROM customer UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
        g AS (SELECT s AS a, t AS b FROM e UNION SELECT t, s FROM e) SELECT split_part(a, ':', 1) AS kind, count(DISTINCT a) AS n_vertices, count(*) AS n_edges FROM g GROUP BY 1""",
    "media_types": r"""SELECT regexp_extract(url, '^(https?):', 1) AS scheme, lower(regexp_extract(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) AS extension, contains(url, '?') AS has_query, contains(url, '#') AS has_fragment, count(*) AS n
        FROM pages GROUP BY ALL""",
}
