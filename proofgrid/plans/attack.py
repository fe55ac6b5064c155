"""Queries over technique matrices: parts as technique objects, brands as tactics, suppliers as software, line items as
their relations and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attack
from ..sources.shared import shared_path
from ..sources.tables import read

STATES = attack.CELL_STATES
VERIFIED = ("validated", "pending", "contested", "inconclusive")


def technique_of(key):
    """Part 123 is T12.003; part 120 is T12."""
    return F.concat(F.lit("T"), F.floor(key / 10).cast("string"), F.when(key % 10 > 0, F.concat(F.lit("."), F.lpad((key % 10).cast("string"), 3, "0"))).otherwise(""))


def matrix_of(key):
    return F.when(F.floor(key / 10) % 6 == 0, "mobile").otherwise("enterprise")


def tactic_of(brand):
    return F.concat(F.lit("TA"), F.lpad(F.regexp_extract(brand, "([0-9]+)", 1), 4, "0"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in version 9.1, and all but each seventh in 10.0."""
    key = F.col("p_partkey")
    versions = F.when(key % 7 != 0, F.array(F.lit("9.1"), F.lit("10.0"))).otherwise(F.array(F.lit("9.1")))
    platforms = F.when(F.col("p_size") % 10 == 0, F.array(F.lit("all"))).otherwise(F.array(F.lower("p_type")))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("attack-pattern--"), key.cast("string")).alias("stix_id"), technique_of(key).alias("external_id"), F.col("p_name").alias("name"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))).alias("phase"),
        platforms.alias("platforms"), (F.col("p_size") >= 49).alias("revoked"), (F.col("p_size") <= 3).alias("deprecated"), matrix_of(key).alias("matrix"), F.explode(versions).alias("version"),
    )


def tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.select(tactic_of(F.col("p_brand")).alias("tactic_id"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))).alias("phase"))


def choice(values: tuple[str, ...], n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as mappings; some name another tactic, a technique that isn't there, or none."""
    key, line = F.col("l_partkey"), F.col("l_linenumber")
    technique = F.when(F.col("l_orderkey") % 31 == 0, F.concat(F.lit("X"), technique_of(key))).otherwise(technique_of(key))
    tactic = F.when(line % 3 == 0, F.concat(F.lit("TA"), F.lpad((F.col("l_suppkey") % 30).cast("string"), 4, "0")))
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), line.cast("string"), key.cast("string"), F.col("l_suppkey").cast("string"), F.round("l_extendedprice", 2).cast("decimal(18,2)").cast("string")).alias("mapping_id"), matrix_of(key).alias("matrix"),
        F.col("l_suppkey").alias("malware_id"), technique.alias("technique_id"), tactic.alias("tactic_id"), choice(STATES, line).alias("state"), choice(VERIFIED, F.col("l_suppkey") + line).alias("verification"), F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.concat(F.lit("procedure "), (F.col("l_orderkey") % 2).cast("string")).alias("procedure"), F.when(line % 5 != 0, F.col("l_orderkey")).alias("evidence_id"), F.col("l_shipdate").alias("created_at"), F.array(F.lower(F.lit("ECONOMY")), F.lit("standard")).alias("platforms"),
    )


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest objects, read from a snapshot that is written once."""
    rows, path = objects(spark, sf_dir), shared_path(spark, "technique-snapshot")
    attack.write_snapshot(rows, path)
    return attack.latest(attack.read_snapshot(spark, path, rows.schema))


def technique_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.versions(objects(spark, sf_dir))


def technique_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live objects of the latest version with the parent of each."""
    return attack.live(current(spark, sf_dir)).select("matrix", "version", "external_id", attack.parent(F.col("external_id")).alias("parent_id"), "name")


def technique_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "uses").when(F.col("l_returnflag") == "R", "mitigates").otherwise("detects")
    relations = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("malware--"), F.col("l_suppkey").cast("string")).alias("source_id"), kind.alias("kind"), F.concat(F.lit("attack-pattern--"), F.col("l_partkey").cast("string")).alias("target_id"))
    return attack.used_techniques(relations, attack.latest(objects(spark, sf_dir)))


def mapping_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attack.checked(mapped(spark, sf_dir), attack.latest(objects(spark, sf_dir)), tactics(spark, sf_dir))
    return rows.select("mapping_id", "ok", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def technique_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the mappings created from 1994 to 1999."""
    window = mapped(spark, sf_dir).where("created_at >= '1994-01-01' AND created_at < '2000-01-01'")
    return attack.cells(attack.with_tactics(window, attack.latest(objects(spark, sf_dir)), tactics(spark, sf_dir)))


def matrix_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.overlay(attack.with_tactics(mapped(spark, sf_dir), attack.latest(objects(spark, sf_dir)), tactics(spark, sf_dir)))


def technique_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier with the next."""
    pairs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id_a"), (F.col("s_suppkey") + 1).alias("id_b"))
    return attack.compared(mapped(spark, sf_dir), pairs)


def technique_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items; both passes and the arbiter follow from the ids."""
    e, u = F.col("event_id"), F.col("user_id")
    name = lambda base, sub: F.concat(F.lit("T"), base.cast("string"), F.when(sub > 0, F.concat(F.lit(".00"), sub.cast("string"))).otherwise(""))
    passes = read(spark, sf_dir, "events").select(
        e.alias("item_id"), F.when(e % 17 != 0, name(u % 9, e % 3)).alias("first"), F.when(e % 19 != 0, name(u % 9 + F.when(e % 5 == 0, 1).otherwise(0), e % 2)).alias("second"),
        (F.col("value") / 250).alias("first_confidence"), (F.col("value") / 375).alias("second_confidence"), choice(("A", "B", "neither"), e).alias("arbiter"),
    )
    return attack.agreed(passes)


QUERIES = {f.__name__: f for f in (technique_versions, technique_objects, technique_use, mapping_checks, technique_matrix, matrix_overlay, technique_comparison, technique_agreement)}

_T = lambda k: f"('T' || ({k} // 10) || CASE WHEN {k} % 10 > 0 THEN '.' || lpad(({k} % 10)::VARCHAR, 3, '0') ELSE '' END)"
_M = lambda k: f"CASE WHEN ({k} // 10) % 6 = 0 THEN 'mobile' ELSE 'enterprise' END"
_LIST = lambda values, n: f"({list(values)})[({n}) % {len(values)} + 1]"
_OBJECTS = f"""WITH o AS (SELECT 'attack-pattern--' || p_partkey AS stix_id, {_T("p_partkey")} AS external_id, p_name AS name, lower(replace(p_brand, '#', '-')) AS phase,
    CASE WHEN p_size % 10 = 0 THEN ['all'] ELSE [lower(p_type)] END AS platforms, p_size >= 49 AS revoked, p_size <= 3 AS deprecated, {_M("p_partkey")} AS matrix,
    unnest(CASE WHEN p_partkey % 7 <> 0 THEN ['9.1', '10.0'] ELSE ['9.1'] END) AS version FROM part),
    tops AS (SELECT matrix, arg_max(version, list_transform(string_split(version, '.'), lambda x: x::INTEGER)) AS top FROM o GROUP BY 1), l AS (SELECT o.* FROM o JOIN tops ON o.matrix = tops.matrix AND version = top),
    ta AS (SELECT DISTINCT 'TA' || lpad(regexp_extract(p_brand, '([0-9]+)', 1), 4, '0') AS tactic_id, lower(replace(p_brand, '#', '-')) AS phase FROM part),
    m AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || round(l_extendedprice, 2)::DECIMAL(18, 2) AS mapping_id, {_M("l_partkey")} AS matrix, l_suppkey AS malware_id,
      CASE WHEN l_orderkey % 31 = 0 THEN 'X' ELSE '' END || {_T("l_partkey")} AS technique_id, CASE WHEN l_linenumber % 3 = 0 THEN 'TA' || lpad((l_suppkey % 30)::VARCHAR, 4, '0') END AS tactic_id,
      {_LIST(STATES, "l_linenumber")} AS state, {_LIST(VERIFIED, "l_suppkey + l_linenumber")} AS verification, round(l_discount * 10, 2) AS confidence, 'procedure ' || (l_orderkey % 2) AS procedure,
      CASE WHEN l_linenumber % 5 <> 0 THEN l_orderkey END AS evidence_id, l_shipdate AS created_at, ['economy', 'standard'] AS on_platforms FROM lineitem),
    w AS (SELECT m.* EXCLUDE (tactic_id), coalesce(m.tactic_id, ta.tactic_id, 'TA??') AS tactic_id FROM m LEFT JOIN l ON m.matrix = l.matrix AND m.technique_id = l.external_id LEFT JOIN ta ON l.phase = ta.phase) """
ORACLES = {
    "technique_versions": _OBJECTS + "SELECT matrix, version, count(*) AS n_objects, version = any_value(top) AS is_latest FROM o JOIN tops USING (matrix) GROUP BY 1, 2",
    "technique_objects": _OBJECTS + "SELECT matrix, version, external_id, split_part(external_id, '.', 1) AS parent_id, name FROM l WHERE NOT revoked AND NOT deprecated",
    "technique_use": _OBJECTS + "SELECT DISTINCT 'malware--' || l_suppkey AS source_id, external_id, split_part(external_id, '.', 1) AS parent_id FROM lineitem JOIN l ON stix_id = 'attack-pattern--' || l_partkey WHERE l_returnflag = 'N'",
    "mapping_checks": _OBJECTS + """, j AS (SELECT m.*, l.external_id IS NOT NULL AS known, l.revoked, l.deprecated, l.phase, l.platforms, p.external_id IS NOT NULL AS has_parent, ta.phase AS tphase FROM m
        LEFT JOIN l ON m.matrix = l.matrix AND m.technique_id = l.external_id LEFT JOIN l p ON m.matrix = p.matrix AND split_part(m.technique_id, '.', 1) = p.external_id LEFT JOIN ta ON m.tactic_id = ta.tactic_id),
        c AS (SELECT mapping_id, list_filter([CASE WHEN NOT known THEN 'unknown technique' END, CASE WHEN revoked THEN 'revoked' END, CASE WHEN known AND NOT revoked AND tactic_id IS NOT NULL AND tphase IS NULL THEN 'unknown tactic' END,
          CASE WHEN known AND NOT revoked AND tphase <> phase THEN 'tactic not of this technique' END, CASE WHEN known AND NOT revoked AND contains(technique_id, '.') AND NOT has_parent THEN 'parent missing' END], lambda x: x IS NOT NULL) AS e,
          list_filter([CASE WHEN known AND NOT revoked AND deprecated THEN 'deprecated' END, CASE WHEN known AND NOT revoked AND NOT list_contains(platforms, 'all') AND NOT list_has_any(platforms, on_platforms) THEN 'platform mismatch' END], lambda x: x IS NOT NULL) AS w FROM j)
        SELECT mapping_id, len(e) = 0 AS ok, coalesce(array_to_string(e, ','), '') AS errors, coalesce(array_to_string(w, ','), '') AS warnings FROM c""",
    "technique_matrix": _OBJECTS + f"""SELECT tactic_id, technique_id, arg_max(state, list_position({list(STATES)}, state)) AS state, max(confidence) AS max_confidence, arg_min(verification, list_position({list(attack.VERIFICATIONS)}, verification)) AS worst_verification,
        count(DISTINCT evidence_id) AS n_evidence, count(DISTINCT malware_id) AS n_malware, count(*) AS n_mappings FROM w WHERE created_at >= '1994-01-01' AND created_at < '2000-01-01' GROUP BY 1, 2""",
    "matrix_overlay": _OBJECTS + "SELECT tactic_id, technique_id, malware_id, arg_max(state, {'c': created_at, 'm': mapping_id}) AS state FROM w GROUP BY 1, 2, 3",
    "technique_comparison": _OBJECTS + """, x AS (SELECT malware_id, procedure, 'subtechnique' AS level, technique_id AS item FROM m WHERE contains(technique_id, '.') UNION ALL SELECT malware_id, procedure, 'technique', split_part(technique_id, '.', 1) FROM m
        UNION ALL SELECT malware_id, procedure, 'tactic', tactic_id FROM m WHERE tactic_id IS NOT NULL), h AS (SELECT malware_id, level, item, string_agg(procedure, ',' ORDER BY procedure) AS p FROM x GROUP BY 1, 2, 3),
        s AS (SELECT s_suppkey AS id_a, s_suppkey + 1 AS id_b FROM supplier), u AS (SELECT id_a, id_b, 'a' AS side, level, item, p FROM s JOIN h ON id_a = malware_id UNION ALL SELECT id_a, id_b, 'b', level, item, p FROM s JOIN h ON id_b = malware_id)
        SELECT id_a, id_b, level, item, CASE WHEN min(side) <> max(side) THEN 'common' ELSE min(side) END AS side, min(side) <> max(side) AND count(DISTINCT p) > 1 AND level = 'technique' AS procedures_differ FROM u GROUP BY 1, 2, 3, 4""",
    "technique_agreement": """WITH p AS (SELECT event_id AS item_id, CASE WHEN event_id % 17 <> 0 THEN 'T' || (user_id % 9) || CASE WHEN event_id % 3 > 0 THEN '.00' || (event_id % 3) ELSE '' END END AS a,
        CASE WHEN event_id % 19 <> 0 THEN 'T' || (user_id % 9 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) || CASE WHEN event_id % 2 > 0 THEN '.00' || (event_id % 2) ELSE '' END END AS b, value / 250 AS ca, value / 375 AS cb, event_id % 3 AS arb FROM events),
        o AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'insufficient_evidence' WHEN a = b THEN 'agree' WHEN split_part(a, '.', 1) = split_part(b, '.', 1) THEN 'partial' ELSE 'disagree' END AS outcome FROM p)
        SELECT item_id, outcome, CASE outcome WHEN 'agree' THEN a WHEN 'partial' THEN CASE WHEN NOT contains(a, '.') THEN a WHEN NOT contains(b, '.') THEN b ELSE a END WHEN 'disagree' THEN CASE arb WHEN 0 THEN a WHEN 1 THEN b END END AS technique_id,
        CASE outcome WHEN 'disagree' THEN CASE WHEN arb < 2 THEN 0.7 ELSE 0.3 END WHEN 'agree' THEN round(least(ca, 0.85), 3) WHEN 'partial' THEN round(least(CASE WHEN contains(a, '.') AND NOT contains(b, '.') THEN cb ELSE ca END, 0.6), 3) ELSE 0.0 END::DOUBLE AS confidence,
        CASE WHEN outcome = 'insufficient_evidence' THEN 'pending' WHEN outcome = 'disagree' AND arb = 2 THEN 'inconclusive' ELSE 'validated' END AS verification FROM o""",
}
