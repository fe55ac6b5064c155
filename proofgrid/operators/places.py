"""Places: boxes and what lies in them, a gazetteer, joined without comparing everything with everything.

Points meet boxes through grid cells of whole degrees: a box is listed in each cell that it touches, a point in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bearing, haversine

# Confidence and precision from least to most.
CONFIDENCE = ("VERY_LOW", "LOW", "MODERATE", "HIGH", "VERY_HIGH")
PRECISION = ("COUNTRY_ONLY", "REGION", "CITY", "APPROXIMATE_AREA", "EXACT")
# What a granularity allows as precision with low, moderate and high confidence.
ALLOWED = {
    "COUNTRY": ("COUNTRY_ONLY", "COUNTRY_ONLY", "COUNTRY_ONLY"), "REGION": ("COUNTRY_ONLY", "REGION", "REGION"), "CITY": ("REGION", "CITY", "CITY"), "NEIGHBORHOOD": ("CITY", "APPROXIMATE_AREA", "APPROXIMATE_AREA"),
    "SITE": ("APPROXIMATE_AREA", "APPROXIMATE_AREA", "EXACT"), "EXACT_COORDINATE": ("APPROXIMATE_AREA", "EXACT", "EXACT"),
}
# Weights of kinds of clue, and what confidence leaves of them.
CLUE_WEIGHTS = {
    "text.address": 0.95, "transit.network": 0.9, "signage.language_script": 0.6, "road.driving_side": 0.35, "road.sign_shape_color": 0.4, "road.number_format": 0.5, "plate_context": 0.25, "architecture.style": 0.3,
    "utility_infrastructure": 0.35, "street_furniture": 0.3, "vegetation": 0.3, "terrain": 0.5, "coastline": 0.55, "climate.weather": 0.2, "shadow.sun": 0.3, "generic": 0.05,
}
CONFIDENCE_FACTORS = (0.0, 0.2, 0.6, 0.9, 1.0)


def cells_of(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Every (row, column) of whole degrees that a box touches, as rows of a generator."""
    rows, columns = F.sequence(F.floor(south), F.floor(north)), F.sequence(F.floor(west), F.floor(east))
    return F.explode(F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.struct(y.alias("row"), x.alias("column"))))))


def contained(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """box_id, point_id for points (point_id, lat, lon) in boxes (box_id, south, west, north, east), edges included."""
    listed = boxes.withColumn("cell", cells_of(F.col("south"), F.col("north"), F.col("west"), F.col("east")))
    placed = points.withColumn("cell", F.struct(F.floor("lat").alias("row"), F.floor("lon").alias("column")))
    return placed.join(listed, "cell").where("lat BETWEEN south AND north AND lon BETWEEN west AND east").select("box_id", "point_id")


def intersecting(boxes: DataFrame) -> DataFrame:
    """box_a, box_b of boxes that share a point; each pair is reported in the first cell both touch."""
    listed = boxes.withColumn("cell", cells_of(F.col("south"), F.col("north"), F.col("west"), F.col("east")))
    a, b = listed.alias("a"), listed.alias("b")
    met = a.join(b, F.expr("a.cell = b.cell AND a.box_id < b.box_id AND a.south <= b.north AND b.south <= a.north AND a.west <= b.east AND b.west <= a.east"))
    first = F.expr("a.cell.row = floor(greatest(a.south, b.south)) AND a.cell.column = floor(greatest(a.west, b.west))")
    return met.where(first).select(F.col("a.box_id").alias("box_a"), F.col("b.box_id").alias("box_b"))


def nearest(points: DataFrame, rings: tuple[int, ...] = (2, 8, 32, 180)) -> DataFrame:
    """point_id, nearest_id, distance_m, bearing_deg of the nearest other of points (point_id, lat, lon); ties go to the least id.

    Points look among those of the grid squares around them, in squares of growing size; who has found a neighbour surely
    nearer than the squares reach is done, so few are left for large squares. Squares close over the poles and the date line.
    """
    from ..sources.shared import held

    left, done = held(points.select("point_id", "lat", "lon")), None
    known = left.select(F.col("point_id").alias("other_id"), F.col("lat").alias("other_lat"), F.col("lon").alias("other_lon"))
    for size in rings:
        count = max(1, 360 // size)
        column = lambda c, size=size: F.floor((c + 180) / size)
        around = F.array(F.lit(-1), F.lit(0), F.lit(1)) if size < 180 else F.array(F.lit(0))
        row = (lambda c, size=size: F.floor((c + 90) / size)) if size < 180 else (lambda c: F.lit(0).cast("long"))
        own_column = (lambda c: F.pmod(column(c), F.lit(count))) if size < 180 else (lambda c: F.lit(0).cast("long"))
        # near the poles a square is narrow: rows there look at all columns
        wide = (F.abs("lat") > 90 - 2 * size) if size < 180 else F.lit(False)
        columns = F.when(wide, F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>")).otherwise(F.array_distinct(F.transform(around, lambda d: F.pmod(own_column(F.col("lon")) + d, F.lit(count)).cast("long"))))
        asked = left.withColumn("at_row", F.explode(F.transform(around, lambda d: row(F.col("lat")) + d))).withColumn("at_column", F.explode(columns))
        there = known.withColumn("at_row", row(F.col("other_lat"))).withColumn("at_column", own_column(F.col("other_lon")).cast("long"))
        pairs = asked.join(there, ["at_row", "at_column"]).where("point_id <> other_id")
        best = pairs.groupBy("point_id").agg(F.min(F.struct(F.round(haversine(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon")), 3).alias("distance_m"), "other_id", F.struct("lat", "lon", "other_lat", "other_lon").alias("p"))).alias("b"))
        p = lambda c: F.col(f"b.p.{c}")
        # one square around a point reaches at least `size` degrees of latitude, and of longitude less towards the poles
        reach = F.lit(size * 111_000.0) * F.cos(F.radians(F.least(F.abs(p("lat")) + 2 * size, F.lit(89.9)))) if size < 180 else F.lit(1e12)
        found = held(best.select("point_id", F.col("b.other_id").alias("nearest_id"), "b.distance_m", F.round(bearing(p("lat"), p("lon"), p("other_lat"), p("other_lon")), 4).alias("bearing_deg"), (F.col("b.distance_m") <= reach).alias("sure")).where("sure").drop("sure"))
        done = found if done is None else done.union(found)
        left = held(left.join(found.select("point_id"), "point_id", "left_anti"))
        if left.isEmpty():
            break
    return done


def gazetteer_matches(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, entry_id: every entry (entry_id, names array, city, region, country) that a query ("name" or "name, qualifier") names."""
    part = lambda k: F.trim(F.get(F.split(F.lower("query"), ","), k))
    asked = queries.select("query_id", part(0).alias("name"), F.coalesce(part(1), F.lit("")).alias("qualifier"))
    named = entries.select("entry_id", F.explode(F.array_distinct(F.transform("names", F.lower))).alias("name"), F.lower("city").alias("city"), F.lower("region").alias("region"), F.lower("country").alias("country"))
    return asked.join(named, "name").where("qualifier = '' OR qualifier IN (city, region, country)").select("query_id", "entry_id")


def without_seen(first: DataFrame, more: DataFrame) -> DataFrame:
    """The matches of one provider, and those of another at points (lat, lon) that the first doesn't have."""
    return first.unionByName(more.join(first.select("lat", "lon").distinct(), ["lat", "lon"], "left_anti").select(*first.columns))


def confidence_rank(value: Column) -> Column:
    """0 to 4; null for other words."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CONFIDENCE)), value), F.lit(0)) - 1


def combined_confidence(primary: Column, others: Column) -> Column:
    """One step up for each corroboration (array) of LOW or better, at most two, never above VERY_HIGH."""
    usable = F.size(F.filter(others, lambda c: confidence_rank(c) >= 1))
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), (F.least(confidence_rank(primary) + F.least(usable, F.lit(2)), F.lit(4)) + 1).cast("int"))


def capped_precision(granularity: Column, confidence: Column, policy: Column) -> Column:
    """What evidence allows as precision, and policy (null: no cap) at most."""
    bands = F.create_map(*[x for g, row in ALLOWED.items() for x in (F.lit(g), F.array(*map(F.lit, row)))])
    band = F.greatest(F.lit(0), F.least(confidence_rank(confidence) - 1, F.lit(2)))
    allowed = F.element_at(F.element_at(bands, granularity), (band + 1).cast("int"))
    order = F.array(*map(F.lit, PRECISION))
    return F.when(F.array_position(order, policy) < F.array_position(order, allowed), policy).otherwise(allowed)


def lowered_precision(precision: Column, steps: Column) -> Column:
    order = F.array(*map(F.lit, PRECISION))
    return F.element_at(order, F.greatest(F.lit(1), F.array_position(order, precision) - steps).cast("int"))


def clue_weight(kind: Column, rank: Column, uniqueness: Column) -> Column:
    base = F.coalesce(F.try_element_at(F.create_map(*[x for k, w in CLUE_WEIGHTS.items() for x in (F.lit(k), F.lit(w))]), kind), F.lit(CLUE_WEIGHTS["generic"]))
    factor = F.element_at(F.array(*map(F.lit, CONFIDENCE_FACTORS)), (F.greatest(F.lit(0), F.least(rank, F.lit(4))) + 1).cast("int"))
    return F.round(base * factor * F.greatest(F.lit(0.0), F.least(F.lit(1.0), uniqueness)), 4)


def agreed_countries(clues: DataFrame) -> DataFrame:
    """case_id, country for the countries that all of a case's clues (clue_id, countries array or null, generic) allow."""
    used = clues.where("NOT generic AND countries IS NOT NULL")
    wanted = used.groupBy("case_id").agg(F.countDistinct("clue_id").alias("n"))
    votes = used.select("case_id", "clue_id", F.explode("countries").alias("country")).groupBy("case_id", "country").agg(F.countDistinct("clue_id").alias("votes"))
    return votes.join(wanted, "case_id").where("votes = n").select("case_id", "country")


def clue_conflicts(clues: DataFrame) -> DataFrame:
    """case_id, n_countries (null without such clues), driving_conflict, contradiction."""
    sides = clues.where("NOT generic").groupBy("case_id").agg(F.count("countries").alias("n_clues"), F.countDistinct("driving_side").alias("sides"))
    left = agreed_countries(clues).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    rows = clues.select("case_id").distinct().join(sides, "case_id", "left").join(left, "case_id", "left")
    n = F.when(F.col("n_clues") > 0, F.coalesce("n", F.lit(0)))
    conflict = F.coalesce(F.col("sides") > 1, F.lit(False))
    return rows.select("case_id", n.alias("n_countries"), conflict.alias("driving_conflict"), (conflict | F.coalesce(n == 0, F.lit(False))).alias("contradiction"))


def geo_gate(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """fact_id, accepted, reason, level for candidates (fact_id, evidence_ids, n_independent, contradicted_by array), by their observations (evidence_id, kind, confidence)."""
    weak = observations.where("kind LIKE 'ocr%' AND confidence IN ('VERY_LOW', 'LOW')").select("evidence_id").distinct()
    flagged = candidates.select("fact_id", F.explode("evidence_ids").alias("evidence_id")).join(weak, "evidence_id", "left_semi").select("fact_id").distinct().withColumn("weak", F.lit(True))
    rows = candidates.join(flagged, "fact_id", "left")
    ladder = [
        (F.size("evidence_ids") == 0, False, "no retained evidence cited", "FACT_CANDIDATE"), (F.col("weak").isNotNull(), False, "low-confidence OCR must remain an observation", "OBSERVATION"),
        (F.size("contradicted_by") > 0, False, "contradicted", "HYPOTHESIS"), (F.col("n_independent") < 2, True, "accepted (SINGLE_SOURCE)", "FACT"), (F.lit(True), True, "accepted", "FACT"),
    ]
    gate = F.coalesce(*[F.when(test, F.struct(F.lit(ok).alias("accepted"), F.lit(why).alias("reason"), F.lit(level).alias("level"))) for test, ok, why, level in ladder])
    return rows.select("fact_id", gate.alias("g")).select("fact_id", "g.*")
