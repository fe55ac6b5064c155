"""Trust plane: contradictions, patterns, fact gate, fusion, claim states. Groups are found by partial aggregation.

Observations have subject_id, predicate, value, evidence_id, source_id, observed_at. A null value counts as "".
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import age_micros

# Freshness windows in hours by predicate namespace, and the predicates and tokens with a meaning of their own.
FRESH_HOURS = {"dns": 24, "ip": 720, "asn": 2160, "registry": 8760, "certificates": 720}
FRESH_HOURS_OTHER = 2160
CONSEQUENTIAL = ("owner", "registrant", "operator", "attributed", "same_person", "belongs_to", "culpab", "fraud", "sanction", "wallet_owner")
FACT_PREDICATES = ("resolves_to", "hosts", "belongs_to_asn", "issued_for", "registered_at", "resolved", "has_record", "prefix_of")


def canonical(value: Column) -> Column:
    """Trimmed lower case, without dots at the end."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"\.+$", "")


def canonical_list(values: Column) -> Column:
    """A list value as text: its items canonical, in order, joined by a bar; null is ""."""
    return F.coalesce(F.array_join(F.array_sort(F.transform(values, canonical)), "|"), F.lit(""))


def given(value: str) -> Column:
    return F.coalesce(F.col(value), F.lit(""))


def consequential(predicate: Column) -> Column:
    return F.lower(F.coalesce(predicate, F.lit(""))).rlike("|".join(CONSEQUENTIAL))


def stale(predicate: Column, seen: Column, now: dt.datetime) -> Column:
    """Whether an observation is older than its namespace's window; without a time it is."""
    space = F.substring_index(predicate, ".", 1)
    window = F.lit(FRESH_HOURS_OTHER)
    for name, hours in FRESH_HOURS.items():
        window = F.when(space == name, hours).otherwise(window)
    age = age_micros(seen, now) / 3.6e9
    return F.coalesce(age > window, F.lit(True))


def contradictions(obs: DataFrame) -> DataFrame:
    """subject, predicate, kind, n_values, n_sources, n_rows for each subject and predicate (case ignored) with several values."""
    groups = obs.groupBy(F.lower("subject_id").alias("subject"), F.lower("predicate").alias("predicate")).agg(
        F.countDistinct(F.lower(F.trim(given("value")))).alias("n_values"), F.countDistinct("source_id").alias("n_sources"), F.count(F.lit(1)).alias("n_rows")
    )
    kind = F.when(F.col("predicate").rlike("date|time|valid|created|updated"), "temporal").when(F.col("n_sources") > 1, "source_disagreement").otherwise("value")
    return groups.where("n_values > 1").select("subject", "predicate", kind.alias("kind"), "n_values", "n_sources", "n_rows")


def shared_values(obs: DataFrame) -> DataFrame:
    """Values that two subjects or more have for a predicate."""
    groups = obs.groupBy("predicate", given("value").alias("value")).agg(F.countDistinct("subject_id").alias("n_subjects"), F.countDistinct("evidence_id").alias("n_evidence"))
    return groups.where("n_subjects >= 2").withColumn("strength", F.least(F.lit(1.0), F.col("n_subjects") / 5.0))


def temporal_coincidence(obs: DataFrame) -> DataFrame:
    """Days on which a subject has three predicates or more."""
    groups = obs.groupBy(F.col("subject_id").alias("subject"), F.date_format("observed_at", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("predicate").alias("n_predicates"))
    return groups.where("n_predicates >= 3").withColumn("strength", F.round(F.least(F.lit(1.0), F.col("n_predicates") / 6.0), 6))


def repetition(obs: DataFrame) -> DataFrame:
    """Claims that occur three times or more, from two sources or more."""
    groups = obs.groupBy(F.col("subject_id").alias("subject"), "predicate", given("value").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source_id").alias("n_sources"))
    return groups.where("n_rows >= 3 AND n_sources >= 2").withColumn("strength", F.least(F.lit(1.0), F.col("n_rows") / 5.0))


def fact_gate(obs: DataFrame, now: dt.datetime, clusters: DataFrame | None = None) -> DataFrame:
    """One record for each subject, predicate and value with evidence, and one for each observation without.

    clusters (evidence_id, cluster_id) says which evidence is one source; by default each evidence id is its own.
    """
    rows = obs.withColumn("canon", canonical(F.col("value"))).withColumn("is_stale", stale(F.col("predicate"), F.col("observed_at"), now))
    with_evidence = rows.where("evidence_id IS NOT NULL")
    if clusters is not None:
        with_evidence = with_evidence.join(clusters, "evidence_id", "left")
        cluster = F.coalesce(F.col("cluster_id").cast("string"), F.col("evidence_id").cast("string"))
    else:
        cluster = F.col("evidence_id").cast("string")
    values = with_evidence.groupBy("subject_id", "predicate", "canon").agg(
        F.countDistinct(cluster).alias("n_clusters"), F.count_if(~F.col("is_stale")).alias("n_fresh"), F.bool_and("is_stale").alias("stale")
    )
    values = values.withColumn("n_values", F.count(F.lit(1)).over(Window.partitionBy("subject_id", "predicate")))
    needs = consequential(F.col("predicate"))
    ladder = [
        (F.col("n_values") > 1, "disputed", 0.35), (F.col("n_fresh") == 0, "inconclusive", 0.2), (needs & (F.col("n_clusters") < 2), "partial", 0.5),
        (needs, "supported", 0.8), (F.col("n_clusters") >= 2, "supported", 0.85), (F.lit(True), "supported", 0.7),
    ]
    outcome = F.coalesce(*[F.when(test, F.struct(F.lit(name).alias("outcome"), F.lit(score).alias("score"))) for test, name, score in ladder])
    judged = values.withColumn("gate", outcome).select(F.col("subject_id").alias("subject"), "predicate", F.col("canon").alias("value"), "gate.outcome", "gate.score", "n_clusters", "n_fresh", "stale")
    zero = F.lit(0).cast("long")
    rejected = rows.where("evidence_id IS NULL").select(
        F.col("subject_id").alias("subject"), "predicate", F.col("canon").alias("value"), F.lit("rejected_no_evidence").alias("outcome"), F.lit(0.0).alias("score"), zero.alias("n_clusters"), zero.alias("n_fresh"), F.lit(False).alias("stale")
    )
    return judged.unionByName(rejected)


def fact_summary(gate: DataFrame) -> DataFrame:
    return gate.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("subject").alias("n_subjects"))


def fusion_statements(obs: DataFrame) -> DataFrame:
    """One statement for each subject and predicate: a fact, an observation, or unknown where values differ."""
    groups = obs.groupBy(F.col("subject_id").alias("subject"), "predicate").agg(
        F.countDistinct(given("value")).alias("n_values"), F.countDistinct("source_id").alias("n_clusters"), F.count("evidence_id").alias("n_evidence")
    )
    stype = F.when(F.col("n_values") != 1, "unknown").when(F.col("predicate").isin(*FACT_PREDICATES) & (F.col("n_evidence") > 0), "fact").otherwise("observation")
    confidence = F.when(F.col("n_values") != 1, "unrated").when(F.col("n_clusters") >= 2, "high").otherwise("moderate")
    return groups.select("subject", "predicate", stype.alias("stype"), confidence.alias("confidence"), "n_clusters")


def insights(obs: DataFrame) -> DataFrame:
    """Shared hosting (a value that several subjects resolve to), and repetition from a single source."""
    sources = obs.agg(F.countDistinct("source_id")).scalar()
    hosting = obs.where("predicate = 'resolves_to'").groupBy("value").agg(F.countDistinct("subject_id").alias("n_members")).where("n_members >= 2")
    hosting = hosting.select(F.lit("shared hosting context").alias("title"), F.col("value").alias("subject_or_value"), "n_members", sources.alias("n_clusters"))
    repeated = obs.groupBy("subject_id", "predicate").agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct("source_id").alias("n_clusters")).where("n_members >= 3 AND n_clusters <= 1")
    return hosting.unionByName(repeated.select(F.lit("repeated but dependent sources").alias("title"), F.concat_ws(" ", "subject_id", "predicate").alias("subject_or_value"), "n_members", "n_clusters"))


def claim_states(obs: DataFrame) -> DataFrame:
    """The state of the claim for each subject and predicate, by distinct values and independent sources."""
    groups = obs.groupBy(F.col("subject_id").alias("subject"), "predicate").agg(
        F.countDistinct(given("value")).alias("n_values"), F.countDistinct(F.when(F.col("evidence_id").isNotNull(), F.col("source_id"))).alias("sources"),
        F.countDistinct("evidence_id").alias("n_evidence"), F.bool_and(F.col("evidence_id").isNotNull()).alias("all_evidence"),
    )
    independent = F.greatest(F.lit(1).cast("long"), F.col("sources"))
    claim = F.when(F.col("n_values") > 1, "DISPUTED").when(independent >= 2, "SUPPORTED").when(F.col("all_evidence"), "PARTIALLY_SUPPORTED").otherwise("INCONCLUSIVE")
    return groups.select("subject", "predicate", claim.alias("claim"), independent.alias("n_independent"), "n_evidence")
