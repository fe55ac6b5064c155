"""Queries over observations: contradictions, patterns, fact gate, fusion, hypotheses, mappings, indicators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import band, freshness, hypothesis_score, indicator_state
from ..functions.times import age_micros
from ..operators import analysis, ledger, trust
from ..sources.adapters import NAMED, TWINS, choose, observations
from ..sources.tables import read

NOW = dt.datetime(2024, 2, 5, tzinfo=dt.timezone.utc)
LATER = dt.datetime(2024, 3, 10, tzinfo=dt.timezone.utc)
TYPES = ("view", "click", "signup", "purchase", "error")
INDICATOR = {"view": "ipv4", "error": "ipv6", "click": "domain", "purchase": "url", "signup": "sha256"}


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.contradictions(observations(spark, sf_dir))


def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.shared_values(observations(spark, sf_dir))


def temporal_coincidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.temporal_coincidence(observations(spark, sf_dir))


def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.repetition(observations(spark, sf_dir))


def fact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.fact_gate(observations(spark, sf_dir), NOW)


def fact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.fact_summary(fact_gate(spark, sf_dir))


def fusion_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.fusion_statements(observations(spark, sf_dir, NAMED))


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.insights(observations(spark, sf_dir, NAMED))


def claim_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.claim_states(observations(spark, sf_dir))


def ach_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is evidence; for a hypothesis (event type) it is inconsistent without such events, consistent with at
    least its fair share, else neutral."""
    events = read(spark, sf_dir, "events")
    users = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0 / F.count(F.lit(1)), 4).alias("weight"), *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in TYPES])
    verdicts = [F.when(F.col(f"n_{t}") == 0, "inconsistent").when(F.col(f"n_{t}") * 5 >= F.col("n"), "consistent").otherwise("neutral").alias(t) for t in TYPES]
    return analysis.ach_matrix(users.select("weight", *verdicts), list(TYPES))


def hypothesis_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses are event types of users; events of value below 10 oppose, all others support."""
    events = read(spark, sf_dir, "events").withColumn("supports", F.col("value") >= 10)
    fresh = F.when(F.col("supports"), freshness(F.col("ts"), NOW))
    sums = events.groupBy(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("hypothesis_id")).agg(
        F.count_if("supports").alias("n"), F.count_if(~F.col("supports")).alias("against"), F.countDistinct(F.when(F.col("supports"), F.col("event_id") % 7)).alias("independent"), F.round(F.coalesce(F.avg(fresh), F.lit(0.0)), 6).alias("fresh")
    )
    severity = F.col("against") / (F.col("n") + F.col("against"))
    score = hypothesis_score(F.least(F.lit(1.0), F.col("n") / 5.0), F.col("independent"), F.when(F.col("against") > 0, 0.7).otherwise(1.0), F.col("fresh"), F.when(F.col("n") > 0, 1.0).otherwise(0.0), contradiction=severity)
    rounded = sums.withColumn("raw_score", F.round(score, 5))
    return rounded.select("hypothesis_id", "raw_score", band(F.col("raw_score")).alias("band"))


def ioc_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("kind", choose("event_type", INDICATOR))
    seen = events.groupBy("kind", "user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    age = F.floor(age_micros(F.col("last"), LATER) / 86.4e9)
    aged = seen.withColumn("age_days", age)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return aged.select(F.concat_ws(":", "kind", F.col("user_id").cast("string")).alias("ioc_id"), shown("first").alias("first_seen"), shown("last").alias("last_seen"), "age_days", indicator_state(F.col("kind"), F.col("age_days")).alias("freshness"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as technique mappings: malware_id, technique_id, tactic_id, confidence, evidence_id."""
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("malware_id"), F.concat_ws(".", "event_type", (F.col("event_id") % 3).cast("string")).alias("technique_id"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("TA"), (F.col("event_id") % 4).cast("string"))).alias("tactic_id"), F.col("value").alias("confidence"), F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("evidence_id"),
    )


def technique_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.technique_overlap(mappings(spark, sf_dir))


def tactic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.tactic_coverage(mappings(spark, sf_dir))


def detection_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of confidence 90 or more stand for rules that detect their technique."""
    rows = mappings(spark, sf_dir)
    return analysis.detection_coverage(rows, rows.where("confidence >= 90"))


def confidence_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("claim_id"), (F.col("value") / 1000).alias("score"))
    return ledger.noisy_or(scores, ["claim_id"], "score")


def incident_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's timeline: undated events last; of a user's events of one kind and hour the later supersede the earlier, which are left out."""
    versions = Window.partitionBy("user_id", "event_type", F.date_trunc("hour", "ts")).orderBy("event_id")
    events = read(spark, sf_dir, "events").withColumn("next", F.lead("event_id").over(versions)).where("next IS NULL").withColumn("at", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    order = Window.partitionBy("user_id").orderBy(F.col("at").asc_nulls_last(), "event_id")
    return events.select(
        F.col("user_id").alias("case_id"), F.row_number().over(order).alias("seq"), "event_id", F.col("event_type").alias("stage"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("event_time"), F.when(F.col("value") >= 50, "documented").otherwise("reported").alias("epistemic_class")
    )


def dual_pass_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over a user's events: the claims of the first four of their ids' eight residues, and of the last four."""
    events = read(spark, sf_dir, "events")
    one = lambda keep: events.where(keep).groupBy(F.col("user_id").alias("item_id")).agg(F.collect_set(F.concat_ws(":", "event_type", F.floor(F.col("value") / 25).cast("string"))).alias("claims"))
    return analysis.dual_pass(one(F.col("event_id") % 8 < 4), one(F.col("event_id") % 8 >= 4))


def hypothesis_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five explanations for each value that two subjects or more resolve to, three for each identity link."""
    obs = observations(spark, sf_dir, NAMED)
    shared = obs.where("predicate = 'resolves_to'").groupBy("value").agg(F.countDistinct("subject_id").alias("n_entities")).where("n_entities >= 2").select(F.concat(F.lit("shared_ip:"), "value").alias("basis"), "n_entities", F.explode(F.array(*map(F.lit, ("common operator", "shared hosting", "CDN or proxy", "reassigned address", "measurement error")))).alias("template"))
    linked = obs.where("predicate = 'same_person_as'").groupBy("subject_id").agg(F.countDistinct("value").alias("n_entities")).select(F.concat(F.lit("identity:"), "subject_id").alias("basis"), "n_entities", F.explode(F.array(*map(F.lit, ("same person", "different persons", "shared account")))).alias("template"))
    return shared.union(linked)


_OBS, _NAMED = TWINS["observations"], TWINS["named"]
_CANON = "regexp_replace(lower(trim(value)), '\\.+$', '')"
_STALE = f"""(epoch_us(TIMESTAMP '2024-02-05') - epoch_us(observed_at)) / 3.6e9 >
    CASE split_part(predicate, '.', 1) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in trust.FRESH_HOURS.items())} ELSE {trust.FRESH_HOURS_OTHER} END"""
_GATE = f"""{_OBS}, r AS (SELECT *, {_CANON} AS canon, {_STALE} AS stale1, regexp_matches(lower(predicate), '{"|".join(trust.CONSEQUENTIAL)}') AS needs FROM obs),
    v AS (SELECT subject, predicate, canon AS value, any_value(needs) AS needs, count(DISTINCT evidence_id) AS n_clusters, count_if(NOT stale1)::BIGINT AS n_fresh, bool_and(stale1) AS stale,
                 count(*) OVER (PARTITION BY subject, predicate) AS n_values FROM r WHERE evidence_id IS NOT NULL GROUP BY subject, predicate, canon),
    gate AS (SELECT subject, predicate, value,
        CASE WHEN n_values > 1 THEN 'disputed' WHEN n_fresh = 0 THEN 'inconclusive' WHEN needs AND n_clusters < 2 THEN 'partial' ELSE 'supported' END AS outcome,
        (CASE WHEN n_values > 1 THEN 0.35 WHEN n_fresh = 0 THEN 0.2 WHEN needs AND n_clusters < 2 THEN 0.5 WHEN needs THEN 0.8 WHEN n_clusters >= 2 THEN 0.85 ELSE 0.7 END)::DOUBLE AS score, n_clusters, n_fresh, stale FROM v
      UNION ALL SELECT subject, predicate, canon, 'rejected_no_evidence', 0.0::DOUBLE, 0, 0, false FROM r WHERE evidence_id IS NULL) """
_MAP = """WITH m AS (SELECT user_id % 5 AS malware_id, event_type || '.' || (event_id % 3) AS technique_id, CASE WHEN event_id % 4 <> 0 THEN 'TA' || (event_id % 4) END AS tactic_id,
    value AS confidence, CASE WHEN event_id % 10 <> 0 THEN event_id END AS evidence_id FROM events) """
_VERDICTS = " UNION ALL ".join(
    f"SELECT '{t}' AS hypothesis_id, weight, CASE WHEN n_{t} = 0 THEN 'inconsistent' WHEN n_{t} * 5 >= n THEN 'consistent' ELSE 'neutral' END AS verdict FROM users" for t in TYPES
)

QUERIES = {
    f.__name__: f
    for f in (
        contradictions, shared_values, temporal_coincidence, repetition, fact_gate, fact_summary, fusion_statements, insights, claim_states, ach_matrix, hypothesis_confidence, ioc_freshness, technique_overlap, tactic_coverage,
        detection_coverage, confidence_combine, incident_order, dual_pass_review, hypothesis_templates,
    )
}

ORACLES = {
    "contradictions": f"""{_OBS} SELECT lower(subject) AS subject, lower(predicate) AS predicate,
        CASE WHEN regexp_matches(lower(predicate), 'date|time|valid|created|updated') THEN 'temporal' WHEN count(DISTINCT source_id) > 1 THEN 'source_disagreement' ELSE 'value' END AS kind,
        count(DISTINCT lower(trim(coalesce(value, '')))) AS n_values, count(DISTINCT source_id) AS n_sources, count(*) AS n_rows
        FROM obs GROUP BY 1, 2 HAVING count(DISTINCT lower(trim(coalesce(value, '')))) > 1""",
    "shared_values": f"""{_OBS} SELECT predicate, coalesce(value, '') AS value, count(DISTINCT subject) AS n_subjects, count(DISTINCT evidence_id) AS n_evidence, least(1.0, count(DISTINCT subject) / 5.0)::DOUBLE AS strength
        FROM obs GROUP BY 1, 2 HAVING count(DISTINCT subject) >= 2""",
    "temporal_coincidence": f"""{_OBS} SELECT subject, strftime(observed_at, '%Y-%m-%d') AS day, count(DISTINCT predicate) AS n_predicates, round(least(1.0, count(DISTINCT predicate) / 6.0::DOUBLE), 6)::DOUBLE AS strength
        FROM obs GROUP BY 1, 2 HAVING count(DISTINCT predicate) >= 3""",
    "repetition": f"""{_OBS} SELECT subject, predicate, coalesce(value, '') AS value, count(*) AS n_rows, count(DISTINCT source_id) AS n_sources, least(1.0, count(*) / 5.0)::DOUBLE AS strength
        FROM obs GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND count(DISTINCT source_id) >= 2""",
    "fact_gate": f"{_GATE} SELECT * FROM gate",
    "fact_summary": f"{_GATE} SELECT outcome, count(*) AS n_records, count(DISTINCT subject) AS n_subjects FROM gate GROUP BY 1",
    "fusion_statements": f"""{_NAMED} SELECT subject, predicate,
        CASE WHEN count(DISTINCT coalesce(value, '')) <> 1 THEN 'unknown' WHEN predicate IN {trust.FACT_PREDICATES} AND count(evidence_id) > 0 THEN 'fact' ELSE 'observation' END AS stype,
        CASE WHEN count(DISTINCT coalesce(value, '')) <> 1 THEN 'unrated' WHEN count(DISTINCT source_id) >= 2 THEN 'high' ELSE 'moderate' END AS confidence, count(DISTINCT source_id) AS n_clusters FROM obs GROUP BY 1, 2""",
    "insights": f"""{_NAMED} SELECT 'shared hosting context' AS title, value AS subject_or_value, count(DISTINCT subject) AS n_members, (SELECT count(DISTINCT source_id) FROM obs) AS n_clusters
        FROM obs WHERE predicate = 'resolves_to' GROUP BY value HAVING count(DISTINCT subject) >= 2 UNION ALL
        SELECT 'repeated but dependent sources', subject || ' ' || predicate, count(*), count(DISTINCT source_id) FROM obs GROUP BY subject, predicate HAVING count(*) >= 3 AND count(DISTINCT source_id) <= 1""",
    "claim_states": f"""{_OBS}, g AS (SELECT subject, predicate, count(DISTINCT coalesce(value, '')) AS v, greatest(1, count(DISTINCT CASE WHEN evidence_id IS NOT NULL THEN source_id END)) AS n_independent,
        count(DISTINCT evidence_id) AS n_evidence, bool_and(evidence_id IS NOT NULL) AS every FROM obs GROUP BY 1, 2)
        SELECT subject, predicate, CASE WHEN v > 1 THEN 'DISPUTED' WHEN n_independent >= 2 THEN 'SUPPORTED' WHEN every THEN 'PARTIALLY_SUPPORTED' ELSE 'INCONCLUSIVE' END AS claim, n_independent, n_evidence FROM g""",
    "ach_matrix": f"""WITH users AS (SELECT user_id, count(*) AS n, round(sum(round(value * 100)::BIGINT) / 100.0::DOUBLE / count(*), 4) AS weight, {", ".join(f"count_if(event_type = '{t}') AS n_{t}" for t in TYPES)} FROM events GROUP BY user_id),
        cells AS ({_VERDICTS}), s AS (SELECT hypothesis_id, count_if(verdict = 'consistent')::BIGINT AS consistent, count_if(verdict = 'inconsistent')::BIGINT AS inconsistent, count_if(verdict = 'neutral')::BIGINT AS neutral,
        round(sum(CASE WHEN verdict = 'inconsistent' THEN weight ELSE 0.0 END), 6)::DOUBLE AS score FROM cells GROUP BY 1) SELECT *, rank() OVER (ORDER BY score)::INTEGER AS rank FROM s""",
    "hypothesis_confidence": """WITH e AS (SELECT *, value >= 10 AS supports FROM events), s AS (SELECT event_type || ':' || user_id AS hypothesis_id, count_if(supports) AS n, count_if(NOT supports) AS against,
        count(DISTINCT CASE WHEN supports THEN event_id % 7 END) AS independent,
        round(coalesce(avg(CASE WHEN supports THEN exp(greatest((epoch_us(TIMESTAMP '2024-02-05') - epoch_us(ts)) / 86.4e9, 0.0) * (-ln(2) / 30.0)) END), 0.0), 6) AS fresh FROM e GROUP BY 1),
        r AS (SELECT hypothesis_id, round(greatest(0.0, least(1.0, 0.3 * least(1.0::DOUBLE, n / 5.0) + 0.2 * least(1.0::DOUBLE, independent / 3.0) + 0.15 * (CASE WHEN against > 0 THEN 0.7 ELSE 1.0 END)::DOUBLE + 0.15 + 0.1 * fresh
          + 0.05 * (CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE - 0.1 * (against / (n + against))))::DOUBLE, 5) AS raw_score FROM s)
        SELECT hypothesis_id, raw_score, CASE WHEN raw_score < 0.2 THEN 'very_low' WHEN raw_score < 0.4 THEN 'low' WHEN raw_score < 0.6 THEN 'moderate' WHEN raw_score < 0.8 THEN 'high' ELSE 'very_high' END AS band FROM r""",
    "ioc_freshness": f"""WITH s AS (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in INDICATOR.items())} END AS kind, user_id, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1, 2),
        a AS (SELECT *, floor((epoch_us(TIMESTAMP '2024-03-10') - epoch_us(l)) / 86.4e9)::BIGINT AS age_days, CASE kind WHEN 'ipv4' THEN 30 WHEN 'ipv6' THEN 30 WHEN 'domain' THEN 60 WHEN 'url' THEN 45 ELSE 3650 END AS ttl FROM s)
        SELECT kind || ':' || user_id AS ioc_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(l, '%Y-%m-%d %H:%M:%S') AS last_seen, age_days,
        CASE WHEN age_days <= ttl * 0.5 THEN 'ACTIVE' WHEN age_days <= ttl THEN 'UNCERTAIN' WHEN kind = 'sha256' THEN 'HISTORICAL' ELSE 'STALE' END AS freshness FROM a""",
    "technique_overlap": f"{_MAP} SELECT technique_id, count(DISTINCT malware_id) AS n_malware, string_agg(DISTINCT malware_id::VARCHAR, ',' ORDER BY malware_id::VARCHAR) AS malware_list, max(confidence) AS max_confidence FROM m GROUP BY 1",
    "tactic_coverage": f"{_MAP} SELECT malware_id, coalesce(tactic_id, 'unassigned') AS tactic_id, count(*) AS mapped, count(evidence_id) AS evidence_backed, count(DISTINCT technique_id) AS n_techniques FROM m GROUP BY 1, 2",
    "detection_coverage": f"{_MAP} SELECT malware_id, technique_id, bool_or(confidence >= 90) AS covered FROM m GROUP BY 1, 2",
    "confidence_combine": """SELECT user_id || ':' || event_type AS claim_id, round(1 - product(1 - greatest(0.0, least(1.0, value / 1000))), 6)::DOUBLE AS noisy_or, round(avg(greatest(0.0, least(1.0, value / 1000))), 6)::DOUBLE AS mean,
        round(min(greatest(0.0, least(1.0, value / 1000))), 6)::DOUBLE AS weakest FROM events GROUP BY 1""",
    "incident_order": """SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 97 <> 0 THEN ts END ASC NULLS LAST, event_id)::INTEGER AS seq, event_id, event_type AS stage,
        strftime(CASE WHEN event_id % 97 <> 0 THEN ts END, '%Y-%m-%d %H:%M:%S') AS event_time, CASE WHEN value >= 50 THEN 'documented' ELSE 'reported' END AS epistemic_class FROM (SELECT * FROM events QUALIFY lead(event_id) OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY event_id) IS NULL)""",
    "dual_pass_review": """WITH c AS (SELECT DISTINCT user_id AS item_id, event_id % 8 < 4 AS first, event_type || ':' || floor(value / 25)::BIGINT AS claim FROM events),
        k AS (SELECT item_id, claim, bool_or(first) AS a, bool_or(NOT first) AS b FROM c GROUP BY 1, 2),
        s AS (SELECT x.item_id, x.a AS xa, bool_or((contains(x.claim, y.claim) OR contains(y.claim, x.claim)) AND CASE WHEN x.a THEN y.b ELSE y.a END) AS held FROM k x JOIN k y USING (item_id) GROUP BY x.item_id, x.claim, x.a),
        n AS (SELECT item_id, count_if(a AND b)::INTEGER AS common, count_if(a AND NOT b)::INTEGER AS only_first, count_if(b AND NOT a)::INTEGER AS only_second FROM k GROUP BY 1),
        m AS (SELECT p.item_id, p.mine, bool_and(p.met) AS held FROM (SELECT x.item_id, m.mine, x.claim, bool_or((contains(x.claim, y.claim) OR contains(y.claim, x.claim)) AND CASE m.mine WHEN 'a' THEN y.b ELSE y.a END) AS met
          FROM k x JOIN (SELECT unnest(['a', 'b']) AS mine) m ON CASE m.mine WHEN 'a' THEN x.a ELSE x.b END JOIN k y USING (item_id) GROUP BY 1, 2, 3) p GROUP BY 1, 2),
        v AS (SELECT n.*, coalesce((SELECT held FROM m WHERE m.item_id = n.item_id AND m.mine = CASE WHEN n.common + n.only_first >= n.common + n.only_second THEN 'b' ELSE 'a' END), false) AS within FROM n)
        SELECT item_id, CASE WHEN common + only_second = 0 THEN 'FIRST_ONLY' WHEN common + only_first = 0 THEN 'SECOND_ONLY' WHEN only_first = 0 AND only_second = 0 THEN 'AGREE' WHEN common = 0 THEN 'DISAGREE' WHEN within THEN 'SEMANTIC' ELSE 'PARTIAL' END AS verdict,
        common, only_first, only_second FROM v""",
    "hypothesis_templates": f"""{_NAMED}, s AS (SELECT 'shared_ip:' || value AS basis, count(DISTINCT subject) AS n_entities FROM obs WHERE predicate = 'resolves_to' GROUP BY 1 HAVING count(DISTINCT subject) >= 2),
        i AS (SELECT 'identity:' || subject AS basis, count(DISTINCT value) AS n_entities FROM obs WHERE predicate = 'same_person_as' GROUP BY 1)
        SELECT basis, n_entities, unnest(['common operator', 'shared hosting', 'CDN or proxy', 'reassigned address', 'measurement error']) AS template FROM s
        UNION ALL SELECT basis, n_entities, unnest(['same person', 'different persons', 'shared account']) FROM i""",
}
