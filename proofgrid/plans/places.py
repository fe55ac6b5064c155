"""Queries over places: nations, customers and suppliers as points, derived from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import places as P
from ..sources.tables import read


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("point_id"), "c_nationkey", ((k * 7919) % 13000 / 100 - 65).alias("lat"), ((k * 104729) % 35000 / 100 - 175).alias("lon"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as boxes of a few degrees."""
    k = F.col("s_suppkey")
    south, west = (k * 3571) % 12000 / 100 - 65, (k * 7127) % 34000 / 100 - 175
    return read(spark, sf_dir, "supplier").select(k.alias("box_id"), south.alias("south"), (south + 2 + k % 9).alias("north"), west.alias("west"), (west + 1 + k % 7).alias("east"))


def haversine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation the nearest other one."""
    from .records import places

    return P.nearest(places(spark, sf_dir).withColumnRenamed("nation_id", "point_id")).withColumnRenamed("point_id", "nation_id")


def customer_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's point, the one so far in a direction of its own, and how near that is."""
    k = F.col("point_id")
    rows = spots(spark, sf_dir).withColumn("way", ((k * 31) % 360).cast("double")).withColumn("far", ((k * 577) % 9000).cast("double"))
    rows = rows.withColumn("end", geo.destination(F.col("lat"), F.col("lon"), F.col("way"), F.col("far")))
    metres = geo.haversine(F.col("lat"), F.col("lon"), F.col("end.lat"), F.col("end.lon"))
    back = F.pmod(geo.bearing(F.col("end.lat"), F.col("end.lon"), F.col("lat"), F.col("lon")) + 180, F.lit(360.0))
    measured = rows.withColumn("metres", metres).withColumn("ellipsoid", geo.ellipsoid_distance("lat", "lon", "end.lat", "end.lon"))
    return measured.select(
        k, F.round("end.lat", 6).alias("end_lat"), F.round("end.lon", 6).alias("end_lon"), F.round("metres", 2).alias("metres"), (F.abs(F.col("ellipsoid") - F.col("metres")) <= 0.01 * F.col("metres") + 0.01).alias("ellipsoid_agrees"),
        F.round(geo.proximity(F.col("metres")), 6).alias("proximity"), (F.col("metres") <= 4000.5).alias("within_radius"), ((F.col("far") == 0) | (geo.angular_difference(back, F.col("way")) <= 30)).alias("bearing_consistent"),
    )


def box_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.contained(spots(spark, sf_dir), boxes(spark, sf_dir))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.intersecting(boxes(spark, sf_dir))


def box_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and outline of each box, from the south-west corner round to it again."""
    corner = lambda x, y: F.concat(F.lit("["), F.format_string("%.2f", x), F.lit(","), F.format_string("%.2f", y), F.lit("]"))
    ring = F.concat_ws(",", *[corner(F.col(x), F.col(y)) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    return boxes(spark, sf_dir).select("box_id", F.round((F.col("south") + F.col("north")) / 2, 4).alias("mid_lat"), F.round((F.col("west") + F.col("east")) / 2, 4).alias("mid_lon"), F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")).alias("geojson"))


def gazetteer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for a nation by name or alias, some with its region or one that may be wrong."""
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    entries = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("entry_id"), F.array("n_name", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("place "), (F.col("n_nationkey") % 7).cast("string"))).alias("names"), F.lit("").alias("city"), F.col("r_name").alias("region"), F.col("n_name").alias("country")
    )
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Nation_"), n.cast("string"))).when(k % 3 == 1, F.concat(F.lit(" n"), n.cast("string"))).otherwise(F.concat(F.lit("Place "), (n % 7).cast("string")))
    region = F.when(k % 4 == 0, ", Asia").when(k % 4 == 1, ", EUROPE").otherwise("")
    return P.gazetteer_matches(read(spark, sf_dir, "customer").select(k.alias("query_id"), F.concat(name, region).alias("query")), entries)


def provider_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of suppliers, and those of customers that no supplier has; both on whole degrees."""
    at = lambda k, a, b: (k * a % b - F.lit(b // 2)).cast("int")
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    first = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("provider"), s.alias("id"), at(s, 3, 40).alias("lat"), at(s, 7, 60).alias("lon"))
    more = read(spark, sf_dir, "customer").select(F.lit("customer").alias("provider"), c.alias("id"), at(c, 11, 40).alias("lat"), at(c, 13, 60).alias("lon"))
    return P.without_seen(first, more)


def coordinate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates written as decimals (some swapped, some no place) or in degrees, minutes and seconds, and read again."""
    k = F.col("c_custkey")
    a, b, frac = (k * 7919) % 100, (k * 104729) % 170, F.lpad(((k * 577) % 10000).cast("string"), 4, "0")
    text = lambda x: x.cast("string")
    decimal = F.when(k % 5 == 0, F.concat(text(b + 95), F.lit("."), frac, F.lit(", "), text(a), F.lit(".25"))).otherwise(F.concat(F.lit("-"), text(a % 90), F.lit("."), frac, F.lit(" , "), text(b), F.lit(".5")))
    dms = F.concat(text(a % 90), F.lit("°"), text(k % 60), F.lit("' "), text(k * 7 % 60), F.lit('"'), F.when(k % 2 == 0, "N").otherwise("S"), F.lit(" "), text(b), F.lit("°"), text(k * 3 % 60), F.lit("'"), F.when(k % 3 == 0, "E").otherwise("W"))
    pair, sexa = geo.decimal_pair(decimal), geo.degrees_minutes(dms)
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), pair["lat"].alias("lat"), pair["lon"].alias("lon"), geo.uncertainty(pair["decimals"]).alias("uncertainty_m"), F.bround(pair["lat"], 2).alias("rounded_lat"), F.round(sexa["lat"], 6).alias("dms_lat"), F.round(sexa["lon"], 6).alias("dms_lon")
    )


def shadow_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sun stood at each event, and whether a shadow seen in some direction fits."""
    u = F.col("user_id")
    lat, lon = ((u * 37) % 120 - 60).cast("double"), ((u * 73) % 360 - 180).cast("double")
    azimuth = geo.sun_azimuth(F.col("ts"), lat, lon)
    seen = ((F.col("event_id") * 53) % 360).cast("double")
    rows = read(spark, sf_dir, "events").select("event_id", F.round(azimuth, 3).alias("azimuth"), seen.alias("seen"))
    return rows.select("event_id", "azimuth", geo.shadow_verdict(F.col("seen"), F.col("azimuth")).alias("verdict"))


def place_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims of a place: combined confidence, allowed and lowered precision, weight of the clue."""
    e = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    confidence = P.combined_confidence(pick(P.CONFIDENCE, e), F.array(pick(P.CONFIDENCE, e * 3), pick(P.CONFIDENCE, e * 7 + 1), pick(P.CONFIDENCE, F.floor(e / 5))))
    policy = F.when(e % 4 == 0, "APPROXIMATE_AREA").when(e % 9 == 0, pick(P.PRECISION, e))
    rows = read(spark, sf_dir, "events").select(e, "value", confidence.alias("confidence"), pick(tuple(P.ALLOWED), F.floor(e / 3)).alias("granularity"), policy.alias("policy"))
    precision = P.capped_precision(F.col("granularity"), F.col("confidence"), F.col("policy"))
    return rows.withColumn("precision", precision).select(
        "event_id", "confidence", "precision", P.lowered_precision(F.col("precision"), F.lit(2)).alias("lowered"), P.clue_weight(pick((*P.CLUE_WEIGHTS, "other"), e), P.confidence_rank(F.col("confidence")), F.col("value") / 311.7).alias("weight")
    )


def clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clues of their user's case: countries by the kind of event, sides of the road by some."""
    e = F.col("event_id")
    countries = F.when(F.col("event_type") == "view", F.array(*map(F.lit, ("DE", "FR", "ES")))).when(F.col("event_type") == "click", F.array(*map(F.lit, ("DE", "FR", "IT")))).when(F.col("event_type") == "error", F.array(*map(F.lit, ("DE", "GB"))))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), e.alias("clue_id"), F.when(e % 10 != 0, countries).alias("countries"), F.when(e % 11 == 0, "left").when(e % 7 == 0, "right").alias("driving_side"), (F.col("value") < 20).alias("generic"))


def agreed_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.agreed_countries(clues(spark, sf_dir))


def clue_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clue_conflicts(clues(spark, sf_dir))


def geo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts with their lines as evidence; some lines are weak readings."""
    lines = read(spark, sf_dir, "lineitem")
    evidence = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    facts = read(spark, sf_dir, "orders").join(
        lines.where("l_linenumber < 5").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(evidence)).alias("ids"), F.countDistinct("l_suppkey").alias("n")), "o_orderkey", "left"
    )  # an order has few lines
    empty = F.array().cast("array<string>")
    candidates = facts.select(F.col("o_orderkey").alias("fact_id"), F.coalesce("ids", empty).alias("evidence_ids"), F.coalesce("n", F.lit(0)).alias("n_independent"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("another"))).otherwise(empty).alias("contradicted_by"))
    confidence = F.element_at(F.array(*map(F.lit, P.CONFIDENCE)), (F.col("l_partkey") % 5 + 1).cast("int"))
    seen = lines.select(evidence.alias("evidence_id"), F.when(F.col("l_suppkey") % 3 == 0, "ocr.sign").otherwise("photo").alias("kind"), confidence.alias("confidence"))
    return P.geo_gate(candidates, seen)


QUERIES = {f.__name__: f for f in (haversine_nearest, customer_legs, box_members, box_overlaps, box_rings, gazetteer_matches, provider_union, coordinate_texts, shadow_checks, place_confidence, agreed_countries, clue_conflicts, geo_gate)}

_SPOTS = "WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 13000 / 100 - 65 AS lat, (c_custkey * 104729) % 35000 / 100 - 175 AS lon FROM customer) "
_BOXES = "b AS (SELECT s_suppkey AS id, (s_suppkey * 3571) % 12000 / 100 - 65 AS s, (s_suppkey * 3571) % 12000 / 100 - 65 + 2 + s_suppkey % 9 AS n, (s_suppkey * 7127) % 34000 / 100 - 175 AS w, (s_suppkey * 7127) % 34000 / 100 - 175 + 1 + s_suppkey % 7 AS e FROM supplier) "
_HAV = lambda a, b, c, d: f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
_BEAR = lambda a, b, c, d: f"(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360) % 360"
_PICK = lambda values, n: f"({list(values)})[({n}) % {len(values)} + 1]"
_RANK = lambda c: f"(list_position({list(P.CONFIDENCE)}, {c}) - 1)"
_USERS = "((user_id * 37) % 120 - 60)::DOUBLE AS lat, ((user_id * 73) % 360 - 180)::DOUBLE AS lon"
_CLUES = """WITH c AS (SELECT user_id AS case_id, event_id, CASE WHEN event_id % 10 <> 0 THEN CASE event_type WHEN 'view' THEN ['DE', 'FR', 'ES'] WHEN 'click' THEN ['DE', 'FR', 'IT'] WHEN 'error' THEN ['DE', 'GB'] END END AS countries,
    CASE WHEN event_id % 11 = 0 THEN 'left' WHEN event_id % 7 = 0 THEN 'right' END AS side, value < 20 AS generic FROM events),
    n AS (SELECT case_id, count(*) AS n FROM c WHERE NOT generic AND countries IS NOT NULL GROUP BY 1), v AS (SELECT case_id, country, count(*) AS votes FROM (SELECT case_id, unnest(countries) AS country FROM c WHERE NOT generic AND countries IS NOT NULL) GROUP BY 1, 2),
    agreed AS (SELECT case_id, country FROM v JOIN n USING (case_id) WHERE votes = n) """
_NEAR = """WITH p AS (SELECT n_nationkey::BIGINT AS id, ((n_nationkey * 37) % 140 - 70)::DOUBLE AS lat, ((n_nationkey * 73) % 360 - 180)::DOUBLE AS lon FROM nation),
    d AS (SELECT a.id AS nation_id, b.id AS nearest_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS distance_m,
      round((degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360, 4) AS bearing_deg
      FROM p a JOIN p b ON a.id <> b.id) """
ORACLES = {
    "haversine_nearest": _NEAR + "SELECT nation_id, nearest_id, distance_m, bearing_deg FROM d QUALIFY row_number() OVER (PARTITION BY nation_id ORDER BY distance_m, nearest_id) = 1",
    "customer_legs": _SPOTS + f""", w AS (SELECT *, ((id * 31) % 360)::DOUBLE AS way, ((id * 577) % 9000)::DOUBLE AS far FROM p), t AS (SELECT *, asin(sin(radians(lat)) * cos(far / 6371008.8) + cos(radians(lat)) * sin(far / 6371008.8) * cos(radians(way))) AS there FROM w),
        d AS (SELECT *, degrees(there) AS elat, (lon + degrees(atan2(sin(radians(way)) * sin(far / 6371008.8) * cos(radians(lat)), cos(far / 6371008.8) - sin(radians(lat)) * sin(there))) + 540) % 360 - 180 AS elon FROM t), m AS (SELECT *, {_HAV("lat", "lon", "elat", "elon")} AS metres FROM d)
        SELECT id AS point_id, round(elat, 6) AS end_lat, round(elon, 6) AS end_lon, round(metres, 2) AS metres, true AS ellipsoid_agrees, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - metres / 5000)), 6) AS proximity, metres <= 4000.5 AS within_radius, true AS bearing_consistent FROM m""",
    "box_members": _SPOTS + ", " + _BOXES + "SELECT b.id AS box_id, p.id AS point_id FROM p JOIN b ON lat BETWEEN s AND n AND lon BETWEEN w AND e",
    "box_overlaps": "WITH " + _BOXES + "SELECT x.id AS box_a, y.id AS box_b FROM b x JOIN b y ON x.id < y.id AND x.s <= y.n AND y.s <= x.n AND x.w <= y.e AND y.w <= x.e",
    "box_rings": "WITH " + _BOXES + """SELECT id AS box_id, round((s + n) / 2, 4) AS mid_lat, round((w + e) / 2, 4) AS mid_lon, '{"type":"Polygon","coordinates":[[' || printf('[%.2f,%.2f],[%.2f,%.2f],[%.2f,%.2f],[%.2f,%.2f],[%.2f,%.2f]', w, s, e, s, e, n, w, n, w, s) || ']]}' AS geojson FROM b""",
    "gazetteer_matches": """WITH q AS (SELECT c_custkey AS id, trim(CASE c_custkey % 3 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN ' n' || c_nationkey ELSE 'place ' || (c_nationkey % 7) END) AS name, CASE c_custkey % 4 WHEN 0 THEN 'asia' WHEN 1 THEN 'europe' ELSE '' END AS q FROM customer),
        e AS (SELECT n_nationkey AS id, unnest([lower(n_name), 'n' || n_nationkey, 'place ' || (n_nationkey % 7)]) AS name, lower(r_name) AS region, lower(n_name) AS country FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT q.id AS query_id, e.id AS entry_id FROM q JOIN e ON q.name = e.name AND (q = '' OR q IN (region, country))""",
    "provider_union": """WITH s AS (SELECT 'supplier' AS provider, s_suppkey AS id, (s_suppkey * 3 % 40 - 20)::INTEGER AS lat, (s_suppkey * 7 % 60 - 30)::INTEGER AS lon FROM supplier)
        SELECT * FROM s UNION ALL SELECT 'customer', c_custkey, (c_custkey * 11 % 40 - 20)::INTEGER, (c_custkey * 13 % 60 - 30)::INTEGER FROM customer WHERE (c_custkey * 11 % 40 - 20, c_custkey * 13 % 60 - 30) NOT IN (SELECT (lat, lon) FROM s)""",
    "coordinate_texts": """WITH k AS (SELECT c_custkey AS k, (c_custkey * 7919) % 100 AS a, (c_custkey * 104729) % 170 AS b, ((c_custkey * 577) % 10000) / 10000 AS f FROM customer),
        d AS (SELECT *, CASE WHEN k % 5 = 0 THEN CASE WHEN b + 95 + f <= 180 AND a + 0.25 <= 90 THEN a + 0.25 END ELSE CASE WHEN a % 90 + f <= 90 THEN -(a % 90 + f) END END::DOUBLE AS lat, CASE WHEN k % 5 = 0 THEN CASE WHEN b + 95 + f <= 180 AND a + 0.25 <= 90 THEN b + 95 + f END ELSE b + 0.5 END::DOUBLE AS lon FROM k)
        SELECT k AS id, lat, lon, CASE WHEN lat IS NULL THEN NULL WHEN k % 5 = 0 THEN 1100.0 ELSE 11000.0 END::DOUBLE AS uncertainty_m, CASE WHEN lat IS NOT NULL THEN round_even(lat::DECIMAL(18, 6), 2) END::DOUBLE AS rounded_lat,
        round((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * (a % 90 + (k % 60) / 60 + (k * 7 % 60) / 3600))::DOUBLE, 6) AS dms_lat, round((CASE WHEN k % 3 = 0 THEN 1 ELSE -1 END * (b + (k * 3 % 60) / 60))::DOUBLE, 6) AS dms_lon FROM d""",
    "shadow_checks": f"""WITH a AS (SELECT event_id, {_USERS}, ((event_id * 53) % 360)::DOUBLE AS seen, hour(ts) + minute(ts) / 60.0::DOUBLE AS h, radians(360.0::DOUBLE / 365.0 * (dayofyear(ts) - 81)) AS b FROM events),
        s AS (SELECT *, radians(23.45::DOUBLE * sin(b)) AS d, radians(15 * (h - 12) + lon + (9.87::DOUBLE * sin(2 * b) - 7.53::DOUBLE * cos(b) - 1.5::DOUBLE * sin(b)) / 4) AS w FROM a),
        z AS (SELECT event_id, seen, round((degrees(atan2(-cos(d) * sin(w), sin(d) * cos(radians(lat)) - cos(d) * sin(radians(lat)) * cos(w))) + 360) % 360, 3) AS azimuth FROM s), f AS (SELECT *, abs(seen - (azimuth + 180)) % 360 AS x FROM z)
        SELECT event_id, azimuth, CASE WHEN least(x, 360 - x) > 25 THEN 'IMPOSSIBLE' ELSE 'CONSISTENT' END AS verdict FROM f""",
    "place_confidence": f"""WITH r AS (SELECT event_id, value, event_id AS e, {_RANK(_PICK(P.CONFIDENCE, "event_id"))} AS p, {" + ".join(f"({_RANK(_PICK(P.CONFIDENCE, n))} >= 1)::INTEGER" for n in ("event_id * 3", "event_id * 7 + 1", "event_id // 5"))} AS usable FROM events),
        c AS (SELECT *, least(p + least(usable, 2), 4) AS rank, {_PICK(tuple(P.ALLOWED), "e // 3")} AS g, CASE WHEN e % 4 = 0 THEN 'APPROXIMATE_AREA' WHEN e % 9 = 0 THEN {_PICK(P.PRECISION, "e")} END AS policy FROM r),
        a AS (SELECT *, (CASE g {" ".join(f"WHEN '{g}' THEN {list(row)}" for g, row in P.ALLOWED.items())} END)[greatest(0, least(rank - 1, 2)) + 1] AS allowed FROM c),
        x AS (SELECT *, CASE WHEN list_position({list(P.PRECISION)}, policy) < list_position({list(P.PRECISION)}, allowed) THEN policy ELSE allowed END AS precision FROM a)
        SELECT event_id, ({list(P.CONFIDENCE)})[rank + 1] AS confidence, precision, ({list(P.PRECISION)})[greatest(1, list_position({list(P.PRECISION)}, precision) - 2)] AS lowered,
        round(({[float(w) for w in (*P.CLUE_WEIGHTS.values(), P.CLUE_WEIGHTS["generic"])]}::DOUBLE[])[e % {len(P.CLUE_WEIGHTS) + 1} + 1] * ({list(P.CONFIDENCE_FACTORS)}::DOUBLE[])[rank + 1] * greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 311.7)), 4) AS weight FROM x""",
    "agreed_countries": _CLUES + "SELECT * FROM agreed",
    "clue_conflicts": _CLUES + """, s AS (SELECT case_id, count(countries) FILTER (NOT generic) AS k, count(DISTINCT side) FILTER (NOT generic) AS sides FROM c GROUP BY 1), g AS (SELECT case_id, count(*) AS n FROM agreed GROUP BY 1)
        SELECT case_id, CASE WHEN k > 0 THEN coalesce(n, 0) END AS n_countries, sides > 1 AS driving_conflict, sides > 1 OR (k > 0 AND coalesce(n, 0) = 0) AS contradiction FROM s LEFT JOIN g USING (case_id)""",
    "geo_gate": f"""WITH l AS (SELECT l_orderkey AS k, l_orderkey || ':' || l_linenumber AS id, l_suppkey, l_linenumber AS n, l_suppkey % 3 = 0 AND l_partkey % 5 < 2 AS weak FROM lineitem), w AS (SELECT id, bool_or(weak) AS weak FROM l GROUP BY 1),
        f AS (SELECT k, count(DISTINCT l_suppkey) AS n, bool_or(w.weak) AS weak FROM l JOIN w USING (id) WHERE n < 5 GROUP BY 1)
        SELECT o_orderkey AS fact_id, k IS NOT NULL AND NOT weak AND o_orderstatus <> 'P' AS accepted, CASE WHEN k IS NULL THEN 'no retained evidence cited' WHEN weak THEN 'low-confidence OCR must remain an observation' WHEN o_orderstatus = 'P' THEN 'contradicted' WHEN n < 2 THEN 'accepted (SINGLE_SOURCE)' ELSE 'accepted' END AS reason,
        CASE WHEN k IS NULL THEN 'FACT_CANDIDATE' WHEN weak THEN 'OBSERVATION' WHEN o_orderstatus = 'P' THEN 'HYPOTHESIS' ELSE 'FACT' END AS level FROM orders LEFT JOIN f ON o_orderkey = k""",
}
