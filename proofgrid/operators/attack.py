"""Technique matrices: versioned objects, uses, checks of mappings, cells, comparisons, agreement of two passes.

Objects have matrix, version, stix_id, external_id, name, phase, platforms (array), revoked, deprecated. Mappings have
mapping_id, matrix, malware_id, technique_id, tactic_id, state, verification, confidence, procedure, evidence_id,
created_at. A sub-technique's id is its parent's, a dot and a number. Null evidence is not counted; a null tactic is
found by the technique's phase.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import violations

# States of a cell and of a verification, from weakest to strongest claim on attention.
CELL_STATES = ("observed", "source_reported", "engine_mapped", "supported", "disputed", "inconclusive")
VERIFICATIONS = ("inconclusive", "contested", "pending", "validated")
# What confidence an outcome of two passes allows at most.
CAPS = {"agree": 0.85, "partial": 0.6, "disagree": 0.4, "insufficient_evidence": 0.3}


def parent(technique_id: Column) -> Column:
    return F.substring_index(technique_id, ".", 1)


def rank_in(order: tuple[str, ...], value: Column) -> Column:
    """Place of a value in an order, from 1; 0 if it isn't there."""
    return F.array_position(F.array(*map(F.lit, order)), value)


def write_snapshot(objects: DataFrame, path: str) -> None:
    """One folder for each matrix and version, never written twice: raises if a version is there. For writers at the same time see sources.versions."""
    keys = ["matrix", "version"]
    try:
        there = objects.sparkSession.read.schema(objects.schema).parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        if taken := objects.select(*keys).distinct().join(there, keys).head():
            raise ValueError(f"version {taken['version']} of {taken['matrix']} is there")
    objects.repartition(*keys).write.partitionBy(*keys).mode("append").parquet(path)


def read_snapshot(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def versions(objects: DataFrame) -> DataFrame:
    """matrix, version, n_objects, is_latest: versions compare by their numbers."""
    counts = objects.groupBy("matrix", "version").agg(F.count(F.lit(1)).alias("n_objects"))
    numbers = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
    top = counts.groupBy("matrix").agg(F.max_by("version", numbers).alias("latest"))
    return counts.join(top, "matrix").select("matrix", "version", "n_objects", (F.col("version") == F.col("latest")).alias("is_latest"))


def latest(objects: DataFrame) -> DataFrame:
    return objects.join(versions(objects).where("is_latest").select("matrix", "version"), ["matrix", "version"])


def live(objects: DataFrame) -> DataFrame:
    return objects.where("NOT revoked AND NOT deprecated")


def used_techniques(relations: DataFrame, objects: DataFrame) -> DataFrame:
    """source_id, external_id, parent_id: the techniques that each software uses (relations: source_id, kind, target_id)."""
    uses = relations.where("kind = 'uses' AND target_id LIKE 'attack-pattern--%'").select("source_id", F.col("target_id").alias("stix_id")).distinct()
    return uses.join(objects.select("stix_id", "external_id"), "stix_id").select("source_id", "external_id", parent(F.col("external_id")).alias("parent_id")).distinct()


def checked(mappings: DataFrame, objects: DataFrame, tactics: DataFrame) -> DataFrame:
    """mappings (with platforms) and ok, errors, warnings against one version's objects; tactics: tactic_id, phase."""
    known = objects.select("matrix", F.col("external_id").alias("technique_id"), "phase", F.col("platforms").alias("listed"), "revoked", "deprecated", F.lit(True).alias("known"))
    parents = objects.select("matrix", F.col("external_id").alias("parent_id"), F.lit(True).alias("has_parent"))
    joined = (
        mappings.withColumn("parent_id", parent(F.col("technique_id"))).join(known, ["matrix", "technique_id"], "left").join(parents, ["matrix", "parent_id"], "left")
        .join(tactics.select("tactic_id", F.col("phase").alias("tactic_phase")), "tactic_id", "left")
    )
    usable = F.col("known").isNotNull() & ~F.col("revoked")
    errors = violations([
        (F.col("known").isNull(), "unknown technique"), (F.coalesce("revoked", F.lit(False)), "revoked"), (usable & F.col("tactic_id").isNotNull() & F.col("tactic_phase").isNull(), "unknown tactic"),
        (usable & (F.col("tactic_phase") != F.col("phase")), "tactic not of this technique"), (usable & F.col("technique_id").contains(".") & F.col("has_parent").isNull(), "parent missing"),
    ])
    elsewhere = (F.size("platforms") > 0) & (F.size("listed") > 0) & ~F.array_contains("listed", "all") & ~F.arrays_overlap("platforms", "listed")
    warnings = violations([(usable & F.col("deprecated"), "deprecated"), (usable & elsewhere, "platform mismatch")])
    return joined.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("ok", F.size("errors") == 0).drop("known", "has_parent", "parent_id", "tactic_phase", "listed", "phase", "revoked", "deprecated")


def with_tactics(mappings: DataFrame, objects: DataFrame, tactics: DataFrame) -> DataFrame:
    """mappings whose missing tactic is that of their technique's phase, or TA??."""
    phases = objects.select("matrix", F.col("external_id").alias("technique_id"), "phase").join(tactics.select(F.col("tactic_id").alias("by_phase"), "phase"), "phase").drop("phase")
    return mappings.join(phases, ["matrix", "technique_id"], "left").withColumn("tactic_id", F.coalesce("tactic_id", "by_phase", F.lit("TA??"))).drop("by_phase")


def cells(mappings: DataFrame) -> DataFrame:
    """tactic_id, technique_id, state (the weakest shows), max_confidence, worst_verification, n_evidence, n_malware, n_mappings."""
    return mappings.groupBy("tactic_id", "technique_id").agg(
        F.max_by("state", rank_in(CELL_STATES, F.col("state"))).alias("state"), F.max("confidence").alias("max_confidence"), F.min_by("verification", rank_in(VERIFICATIONS, F.col("verification"))).alias("worst_verification"),
        F.countDistinct("evidence_id").alias("n_evidence"), F.countDistinct("malware_id").alias("n_malware"), F.count(F.lit(1)).alias("n_mappings"),
    )


def overlay(mappings: DataFrame) -> DataFrame:
    """tactic_id, technique_id, malware_id and the state of its last mapping."""
    return mappings.groupBy("tactic_id", "technique_id", "malware_id").agg(F.max_by("state", F.struct("created_at", "mapping_id")).alias("state"))


def compared(mappings: DataFrame, pairs: DataFrame) -> DataFrame:
    """id_a, id_b, level, item, side (common, a, b), procedures_differ for pairs of malware.

    Procedures of a shared technique differ if the sets of both with their numbers do; sums of the halves of hashes stand
    for the sets. All that is summed or compared is a number, so that it goes by hash and without a sort.
    """
    effective = mappings.select("malware_id", F.xxhash64("procedure").alias("code"), F.explode(F.array(
        F.struct(F.lit("subtechnique").alias("level"), F.when(F.col("technique_id").contains("."), F.col("technique_id")).alias("item")), F.struct(F.lit("technique").alias("level"), parent(F.col("technique_id")).alias("item")), F.struct(F.lit("tactic").alias("level"), F.col("tactic_id").alias("item")),
    )).alias("x")).select("malware_id", "code", "x.level", "x.item").where("item IS NOT NULL")
    sums = [F.sum(half).alias(name) for name, half in (("high", F.shiftright("code", 32)), ("low", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))), ("n", F.lit(1)))]
    held = effective.groupBy("malware_id", "level", "item").agg(*sums)
    sides = pairs.select("id_a", "id_b", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("id_a").alias("malware_id")), F.struct(F.lit(1).alias("side"), F.col("id_b").alias("malware_id")))).alias("s")).select("id_a", "id_b", "s.side", "s.malware_id")
    span = lambda c: [F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}")]
    both = sides.join(held, "malware_id").groupBy("id_a", "id_b", "level", "item").agg(*[x for c in ("side", "high", "low", "n") for x in span(c)])
    side = F.when(F.col("least_side") != F.col("most_side"), "common").when(F.col("least_side") == 0, "a").otherwise("b")
    differ = F.expr("least_high <> most_high OR least_low <> most_low OR least_n <> most_n")
    return both.select("id_a", "id_b", "level", "item", side.alias("side"), ((side == "common") & differ & (F.col("level") == "technique")).alias("procedures_differ"))


def agreed(passes: DataFrame) -> DataFrame:
    """item_id, outcome, technique_id, confidence, verification of two passes' techniques (first, second, their confidences, arbiter).

    first and second are null where a pass had too little evidence. Partial agreement prefers the parent; on disagreement
    an arbiter's choice (A or B) decides with a confidence of 0.7, and without one the mapping stays inconclusive.
    """
    a, b = F.col("first"), F.col("second")
    outcome = F.when(a.isNull() | b.isNull(), "insufficient_evidence").when(a == b, "agree").when(parent(a) == parent(b), "partial").otherwise("disagree")
    decided = F.when(F.col("arbiter") == "A", a).when(F.col("arbiter") == "B", b)
    chosen = F.when(F.col("outcome") == "agree", a).when(F.col("outcome") == "partial", F.when(~a.contains("."), a).when(~b.contains("."), b).otherwise(a)).when(F.col("outcome") == "disagree", decided)
    own = F.when(F.col("outcome") == "partial", F.when(a.contains(".") & ~b.contains("."), F.col("second_confidence")).otherwise(F.col("first_confidence"))).otherwise(F.col("first_confidence"))
    cap = F.element_at(F.create_map(*[x for k, v in CAPS.items() for x in (F.lit(k), F.lit(v))]), F.col("outcome"))
    confidence = F.when(F.col("outcome") == "disagree", F.when(decided.isNotNull(), 0.7).otherwise(0.3)).when(F.col("outcome") != "insufficient_evidence", F.round(F.least(own, cap), 3)).otherwise(0.0)
    verification = F.when(F.col("outcome") == "insufficient_evidence", "pending").when((F.col("outcome") == "disagree") & decided.isNull(), "inconclusive").otherwise("validated")
    return passes.withColumn("outcome", outcome).select("item_id", "outcome", chosen.alias("technique_id"), confidence.alias("confidence"), verification.alias("verification"))
