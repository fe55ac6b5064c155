"""Entities from observations: normal names, typed vertices and edges, lookups, matches of names and attributes.

Observations have subject, predicate, value, evidence_id. Blank subjects and values name nothing; an id is kind:name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import valid_ipv4
from .analysis import name_similarity

# Kinds whose names alone never make a match.
WEAK_KINDS = ("person", "username", "email")
# Into how many parts the rows of one block are dealt when pairs are made.
LANES = 8
# What a predicate says of its value, and what ties it to the subject.
COLLECTED = {
    "dns.a": ("resolves_to", "ip_address"), "dns.aaaa": ("resolves_to", "ip_address"), "ip.asn": ("belongs_to_asn", "asn"), "ip.organization": ("operated_by", "organization"), "ip.location": ("located_at", "location"), "domain.subdomain_seen_in_ct": ("issued_for", "domain"),
}


def normal_name(kind: Column, value: Column) -> Column:
    """Lower case and trimmed; domains without www. and dots at the end, AS numbers in upper case, dots and runs of blanks in names of people and firms as one blank."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    domain = F.regexp_replace(F.regexp_replace(v, r"^www\.", ""), r"\.+$", "")
    spaced = F.trim(F.regexp_replace(F.replace(v, F.lit("."), F.lit(" ")), r"\s+", " "))
    return F.when(kind == "domain", domain).when(kind == "asn", F.upper(v)).when(kind.isin("person", "username", "organization"), spaced).otherwise(v)


def value_kind(predicate: Column, value: Column) -> Column:
    """The kind of entity that an observation's value names; null if none."""
    return (
        F.when(predicate.startswith("dns.a") | (predicate == "infra.ip"), "ip_address").when(predicate.startswith("dns.") & value.contains(".") & ~value.contains("@"), "domain").when(predicate == "domain.subdomain_seen_in_ct", "domain")
        .when(predicate == "registrar", "organization").when(predicate.endswith(".nameserver"), "domain")
    )


def typed_edges(obs: DataFrame) -> DataFrame:
    """source_kind, source, target_kind, target, kind, n_evidence: each subject and the entity its value names."""
    subject, value = F.lower(F.trim("subject")), F.lower(F.trim("value"))
    rows = obs.where("trim(subject) <> '' AND trim(value) <> ''").select(F.when(valid_ipv4(subject), "ip_address").otherwise("domain").alias("source_kind"), subject.alias("source"), value_kind(F.col("predicate"), value).alias("target_kind"), value.alias("v"), "predicate", "evidence_id")
    kind = F.when(F.col("target_kind") == "ip_address", "resolves_to").when(F.col("predicate").endswith("nameserver"), "hosts").otherwise("related_to")
    typed = rows.where("target_kind IS NOT NULL").withColumn("target", normal_name(F.col("target_kind"), F.col("v"))).withColumn("kind", kind)
    return typed.groupBy("source_kind", "source", "target_kind", "target", "kind").agg(F.countDistinct("evidence_id").alias("n_evidence"))


def typed_vertices(obs: DataFrame) -> DataFrame:
    """kind, name, n_evidence of all subjects and of the entities that values name."""
    subject, value = F.lower(F.trim("subject")), F.lower(F.trim("value"))
    own = obs.where("trim(subject) <> ''").select(F.when(valid_ipv4(subject), "ip_address").otherwise("domain").alias("kind"), subject.alias("name"), "evidence_id")
    kind = value_kind(F.col("predicate"), value)
    named = obs.where("trim(subject) <> '' AND trim(value) <> ''").select(kind.alias("kind"), normal_name(kind, F.col("value")).alias("name"), "evidence_id").where("kind IS NOT NULL")
    return own.unionByName(named).groupBy("kind", "name").agg(F.countDistinct("evidence_id").alias("n_evidence"))


def collected_edges(obs: DataFrame) -> DataFrame:
    """source, kind, target_kind, target, n_evidence for observations with evidence whose predicate is collected; an entity isn't tied to itself."""
    table = F.create_map(*[x for p, (edge, kind) in COLLECTED.items() for x in (F.lit(p), F.struct(F.lit(edge).alias("edge"), F.lit(kind).alias("kind")))])
    rows = obs.where("evidence_id IS NOT NULL").withColumn("m", F.try_element_at(table, F.col("predicate"))).where("m IS NOT NULL")
    named = rows.select(F.lower(F.trim("subject")).alias("source"), F.col("m.edge").alias("kind"), F.col("m.kind").alias("target_kind"), normal_name(F.col("m.kind"), F.col("value")).alias("target"), "evidence_id")
    return named.where("target <> '' AND target <> source").groupBy("source", "kind", "target_kind", "target").agg(F.countDistinct("evidence_id").alias("n_evidence"))


def looked_up(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (query_id, kind, value) with the vertex (kind, name) of the same normal name, null if there is none."""
    asked = wanted.withColumn("name", normal_name(F.col("kind"), F.col("value")))
    return asked.join(vertices.select("kind", "name", "n_evidence"), ["kind", "name"], "left").select("query_id", "kind", "name", "n_evidence")


def match_state(score: Column, weak: Column, corroborated: Column) -> Column:
    """How far two entities match; weak kinds need corroboration, and a full match needs two pieces of evidence."""
    return (
        F.when(weak & (score < 1.0) & ~corroborated, "UNRESOLVED").when((score >= 1.0) & corroborated, "VERIFIED_MATCH").when(score >= 0.93, "PROBABLE_MATCH").when(score >= 0.85, "POSSIBLE_MATCH").when(score >= 0.6, "UNRESOLVED").otherwise("LIKELY_DISTINCT")
    )


def matched_pairs(entities: DataFrame, blocks: list[str], attributes: list[str]) -> DataFrame:
    """left_id, right_id, score, state for pairs of entities (id, kind, name, n_evidence) of one kind and block.

    The score is the likeness of normal names, 0.05 more for each attribute that both have alike, at most 1. Every pair of a
    block is scored, so the rows of a block are dealt over LANES tasks, each of which meets all of the block: the pairs are
    the work, and the few bytes that they come from would otherwise be merged into a task or two.
    """
    columns = ["id", "n_evidence", "norm", *attributes]
    rows = entities.withColumn("norm", normal_name(F.col("kind"), F.col("name"))).where("norm <> ''").select("kind", *blocks, *columns)
    left, right = (rows.withColumnsRenamed({c: f"{side}_{c}" for c in columns}) for side in ("left", "right"))
    keys = ["kind", *blocks, "lane"]
    many = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("lane", F.pmod(F.xxhash64("left_id"), F.lit(LANES))).repartition(many, *keys)
    right = right.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long")))).repartition(many, *keys)
    pairs = left.join(right.hint("shuffle_hash"), keys).where("left_id < right_id")
    alike = sum((F.when((F.col(f"left_{a}") == F.col(f"right_{a}")) & (F.col(f"left_{a}").cast("string") != ""), 1).otherwise(0) for a in attributes), F.lit(0))
    likeness = F.when(F.col("left_norm") == F.col("right_norm"), 1.0).otherwise(name_similarity("left_norm", "right_norm"))
    scored = pairs.withColumn("score", F.round(F.least(F.lit(1.0), likeness + 0.05 * alike), 4))
    state = match_state(F.col("score"), F.col("kind").isin(*WEAK_KINDS), F.col("left_n_evidence") + F.col("right_n_evidence") >= 2)
    return scored.select("left_id", "right_id", "score", state.alias("state"))
