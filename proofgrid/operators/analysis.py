"""Hypotheses, mappings, profiles, diffs, entity pairs, rankings."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ach_matrix(evidence: DataFrame, hypotheses: list[str]) -> DataFrame:
    """hypothesis_id, consistent, inconsistent, neutral, score, rank; evidence has a weight and a verdict column a hypothesis.

    score is the weight of inconsistent evidence, and the lowest ranks first. Verdicts are unpivoted within each row, so
    no evidence meets hypotheses by a cross join.
    """
    cells = evidence.select("weight", F.explode(F.array(*[F.struct(F.lit(h).alias("hypothesis_id"), F.col(h).alias("verdict")) for h in hypotheses])).alias("c"))
    sums = cells.groupBy("c.hypothesis_id").agg(
        *[F.count_if(F.col("c.verdict") == v).alias(v) for v in ("consistent", "inconsistent", "neutral")], F.round(F.sum(F.when(F.col("c.verdict") == "inconsistent", F.col("weight")).otherwise(0.0)), 6).alias("score")
    )
    return sums.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy("score")))  # one row a hypothesis


def technique_overlap(mappings: DataFrame) -> DataFrame:
    """technique_id, n_malware, malware_list, max_confidence."""
    return mappings.groupBy("technique_id").agg(F.countDistinct("malware_id").alias("n_malware"), F.array_join(F.array_sort(F.collect_set(F.col("malware_id").cast("string"))), ",").alias("malware_list"), F.max("confidence").alias("max_confidence"))


def tactic_coverage(mappings: DataFrame) -> DataFrame:
    """malware_id, tactic_id, mapped, evidence_backed, n_techniques."""
    return mappings.groupBy("malware_id", F.coalesce("tactic_id", F.lit("unassigned")).alias("tactic_id")).agg(F.count(F.lit(1)).alias("mapped"), F.count("evidence_id").alias("evidence_backed"), F.countDistinct("technique_id").alias("n_techniques"))


def detection_coverage(mappings: DataFrame, rules: DataFrame) -> DataFrame:
    """malware_id, technique_id, covered: whether a rule (malware_id, technique_id) detects each mapped technique."""
    mapped = mappings.select("malware_id", "technique_id").distinct()
    found = rules.select("malware_id", "technique_id").distinct().withColumn("covered", F.lit(True))
    return mapped.join(found, ["malware_id", "technique_id"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


# Semantic tags of a value, most specific first.
TAGS = {
    "email": r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+$",
    "ip_address": r"^([0-9]{1,3}\.){3}[0-9]{1,3}$",
    "cve": r"(?i)^CVE-[0-9]{4}-[0-9]{4,7}$",
    "url": r"^https?://[^\s]+$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+Z?)?$",
    "integer": r"^[0-9]+$",
    "float": r"^-?[0-9]+(\.[0-9]+)?$",
    "identifier_like": r"^[A-Za-z][A-Za-z_.-][A-Za-z0-9_.-]{0,29}$",
}


def schema_profile(table: DataFrame, name: str) -> DataFrame:
    """One row a column: inferred type, nullability, distinct share, candidate key. A type holds for 80 % of the values."""
    cells = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in table.columns])).alias("c")).select("c.*")
    known = F.when(F.trim("value") != "", F.trim("value"))
    sums = cells.groupBy("column_name").agg(
        F.count(known).alias("n"), F.count(F.lit(1)).alias("rows"), F.countDistinct(known).alias("distinct"), *[F.count_if(known.rlike(p)).alias(t) for t, p in TAGS.items()]
    )
    kind = F.coalesce(*[F.when(F.col(t) >= 0.8 * F.col("n"), t) for t in TAGS])
    itype = F.when(kind.isin("integer", "float", "timestamp"), kind).otherwise("string")
    share = F.round(F.col("distinct") / F.greatest(F.col("n"), F.lit(1)), 6)
    nullable = F.col("n") < F.col("rows")
    return sums.select(F.lit(name).alias("table_name"), "column_name", F.coalesce(itype, F.lit("string")).alias("inferred_type"), nullable.alias("nullable"), share.alias("unique_ratio"), ((share >= 0.99) & ~nullable).alias("is_candidate_key"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change_kind, old_value, new_value of two snapshots (key, value)."""
    before, after = old.select("key", F.col("value").alias("old_value"), F.lit(True).alias("was")), new.select("key", F.col("value").alias("new_value"), F.lit(True).alias("is"))
    joined = before.join(after, "key", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return joined.withColumn("change_kind", kind).where("change_kind IS NOT NULL").select("key", "change_kind", "old_value", "new_value")


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, four digits; names that come again in a batch are aligned once."""
    pairs = list(zip(a, b, strict=True))
    ratio = {(x, y): round(difflib.SequenceMatcher(None, x or "", y or "").ratio(), 4) for x, y in set(pairs)}
    return pd.Series([ratio[p] for p in pairs], dtype="float64")


def er_state(score: Column) -> Column:
    return F.when(score >= 0.93, "PROBABLE_MATCH").when(score >= 0.85, "POSSIBLE_MATCH").when(score >= 0.6, "UNRESOLVED").otherwise("LIKELY_DISTINCT")


def er_pairs(entities: DataFrame, blocks: list[str]) -> DataFrame:
    """left_id, right_id, score, state for entities (id, name) that share all blocks; equal names are one entity first."""
    names = entities.groupBy(*blocks, F.lower(F.trim("name")).alias("name")).agg(F.min("id").alias("id"))
    left, right = names.withColumnsRenamed({"id": "left_id", "name": "left_name"}), names.withColumnsRenamed({"id": "right_id", "name": "right_name"})
    scored = left.join(right, blocks).where("left_id < right_id").withColumn("score", name_similarity("left_name", "right_name"))
    return scored.select("left_id", "right_id", "score", er_state(F.col("score")).alias("state"))


def dual_pass(first: DataFrame, second: DataFrame) -> DataFrame:
    """item_id, verdict, common, only_first, only_second for the claims (array) of two analysis passes.

    A null array is a pass that failed. Where claims are shared and others are not, each claim of the smaller pass being
    part of one of the larger, or the other way round, is agreement in substance.
    """
    both = first.select("item_id", F.col("claims").alias("a")).join(second.select("item_id", F.col("claims").alias("b")), "item_id", "full_outer")
    empty = F.array().cast("array<string>")
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    common, only_a, only_b = F.size(F.array_intersect(a, b)), F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    larger, smaller = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    within = F.forall(smaller, lambda x: F.exists(larger, lambda y: F.contains(y, x) | F.contains(x, y)))
    verdict = (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "NO_CLAIMS").when(F.size(b) == 0, "FIRST_ONLY").when(F.size(a) == 0, "SECOND_ONLY")
        .when((only_a == 0) & (only_b == 0), "AGREE").when(common == 0, "DISAGREE").when(within, "SEMANTIC").otherwise("PARTIAL")
    )
    return both.select("item_id", verdict.alias("verdict"), common.alias("common"), only_a.alias("only_first"), only_b.alias("only_second"))
