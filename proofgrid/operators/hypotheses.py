"""Hypotheses: components of their scores, updates by new evidence, run-to-run changes, gaps, actions, overlay edges.

Links have hypothesis_id, evidence_id, supports (true or false). Evidence has evidence_id, source_id, authority, seen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import band, freshness, hypothesis_score
from .state import LIFECYCLE

LIVE = ("active", "testing", "strengthened", "weakened", "supported", "disputed")
CLOSED = ("falsified", "archived")
BANDS = ("very_low", "low", "moderate", "high", "very_high")


def components(links: DataFrame, evidence: DataFrame, now: dt.datetime, severity: Column, best_alternative: DataFrame | None = None, assumptions: Column | None = None, required: DataFrame | None = None) -> DataFrame:
    """hypothesis_id, n_support, n_oppose, strength, authority, independent, temporal, coverage, fresh, severity, alternative, burden, balance, score, band.

    severity is a column of n_support and n_oppose. required (hypothesis_id, source_id) lists the sources a hypothesis
    needs; coverage is the share of them that support it, and without any it is 1 with support and 0 without.
    """
    joined = links.join(evidence, "evidence_id")
    supports = F.col("supports")
    # names of its own, so that no column of the inputs stands in their way
    sums = joined.groupBy("hypothesis_id").agg(
        F.count_if(supports).alias("n_support"), F.count_if(~supports).alias("n_oppose"), F.round(F.coalesce(F.avg(F.when(supports, F.col("authority"))), F.lit(0.0)), 3).alias("mean_authority"),
        F.countDistinct(F.when(supports, F.col("source_id"))).alias("independent"), F.round(F.coalesce(F.avg(F.when(supports, freshness(F.col("seen"), now))), F.lit(0.0)), 6).alias("fresh"),
    )
    if required is not None:
        have = joined.where("supports").select("hypothesis_id", "source_id").distinct().withColumn("held", F.lit(1))
        share = required.distinct().join(have, ["hypothesis_id", "source_id"], "left").groupBy("hypothesis_id").agg(F.round(F.sum(F.coalesce("held", F.lit(0))) / F.count(F.lit(1)), 3).alias("share"))
        sums = sums.join(share, "hypothesis_id", "left")
    else:
        sums = sums.withColumn("share", F.lit(None).cast("double"))
    if best_alternative is not None:
        sums = sums.join(best_alternative, "hypothesis_id", "left").withColumn("alternative", F.coalesce("alternative", F.lit(0.0)))
    else:
        sums = sums.withColumn("alternative", F.lit(0.0))
    rows = (
        sums.withColumn("strength", F.round(F.least(F.lit(1.0), F.col("n_support") / 5.0), 3)).withColumn("severity", F.round(severity, 3))
        .withColumn("temporal", F.when(F.col("n_oppose") == 0, 1.0).when(F.col("severity") > 0.5, 0.4).otherwise(0.7))
        .withColumn("coverage", F.coalesce("share", F.when(F.col("n_support") > 0, 1.0).otherwise(0.0)))
        .withColumn("burden", (F.lit(0) if assumptions is None else assumptions).cast("int"))
        .withColumn("balance", F.round((F.col("n_support") - F.col("n_oppose")) / (F.col("n_support") + F.col("n_oppose")), 6))
    )
    c = F.col
    score = hypothesis_score(c("strength"), c("independent"), c("temporal"), c("fresh"), c("coverage"), contradiction=c("severity"), assumptions=c("burden"), alternative=c("alternative"))
    scored = rows.withColumn("score", F.round(score, 5))
    return scored.select("hypothesis_id", "n_support", "n_oppose", "strength", F.col("mean_authority").alias("authority"), "independent", "temporal", "coverage", "fresh", "severity", "alternative", "burden", "balance", "score", band(F.col("score")).alias("band"))


def moved(status: Column, target: str) -> Column:
    """The status after a wish to move: the target where the lifecycle allows it, else the same."""
    return F.when(status.isin(*[s for s, after in LIFECYCLE.items() if target in after]), target).otherwise(status)


def updated(status: Column, strong: Column, independent: Column, opposed: Column, severity: Column, new_support: Column, new_opposition: Column, falsified: Column) -> Column:
    """The status of a hypothesis after new evidence."""
    reachable = [s for s, after in LIFECYCLE.items() if "falsified" in after]
    to_test = F.when(status.isin(*reachable), status).otherwise(moved(status, "testing"))
    begun = F.when(status.isin("proposed", "active"), "testing").otherwise(status)
    judged = (
        F.when(strong & ~opposed & (independent >= 2), moved(begun, "supported")).when(strong & ~opposed, moved(begun, "strengthened")).when(opposed & (severity > 0.5), moved(begun, "disputed"))
        .when(new_opposition, moved(begun, "weakened")).when(new_support, moved(begun, "strengthened")).otherwise(begun)
    )
    return F.when(falsified, moved(to_test, "falsified")).otherwise(judged)


def run_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """hypothesis_id, kind, from_status, to_status between two runs (hypothesis_id, status, band); unchanged ones are left out."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, BANDS)), c)
    before = old.select("hypothesis_id", F.col("status").alias("from_status"), rank(F.col("band")).alias("low"), F.lit(True).alias("was"))
    after = new.select("hypothesis_id", F.col("status").alias("to_status"), rank(F.col("band")).alias("high"), F.lit(True).alias("is"))
    both = before.join(after, "hypothesis_id", "full_outer")
    kind = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("from_status") == F.col("to_status"), None).when(F.col("to_status") == "falsified", "falsified")
        .when(F.col("high") > F.col("low"), "strengthened").when(F.col("high") < F.col("low"), "weakened").otherwise("status")
    )
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("hypothesis_id", "kind", F.coalesce("from_status", F.lit("")).alias("from_status"), F.coalesce("to_status", F.lit("")).alias("to_status"))


def tokens(text: Column) -> Column:
    """The distinct words of three ASCII letters, digits or underscores and more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]{3,})"), 1))


def lexical_verdict(statement: Column, description: Column) -> Column:
    """consistent, neutral or unknown by the share of words in common; never inconsistent without an explicit mark."""
    shared, all_ = F.size(F.array_intersect(statement, description)), F.size(F.array_union(statement, description))
    return F.when((F.size(statement) == 0) | (F.size(description) == 0), "unknown").when(shared >= 0.25 * all_, "consistent").when(shared <= 0.05 * all_, "neutral").otherwise("unknown")


def explanation_groups(hypotheses: DataFrame) -> DataFrame:
    """entities, n_hypotheses, first_id: hypotheses (hypothesis_id, entities array) about the same first three entities, two or more."""
    key = F.array_join(F.array_sort(F.array_distinct(F.slice("entities", 1, 3))), ",")
    return hypotheses.groupBy(key.alias("entities")).agg(F.count(F.lit(1)).alias("n_hypotheses"), F.min("hypothesis_id").alias("first_id")).where("n_hypotheses >= 2")


def derived_gaps(required: DataFrame, contradictions: DataFrame) -> DataFrame:
    """question, why, value, priority: what live hypotheses (hypothesis_id, status, question) need, and each contradiction (subject, predicate), each question once."""
    needed = required.where(~F.col("status").isin(*CLOSED)).groupBy("question").agg(F.min("hypothesis_id").alias("first")).select("question", F.concat(F.lit("required to test "), "first").alias("why"), F.lit(0.6).alias("value"))
    asked = contradictions.select(F.concat(F.lit("Resolve conflict: "), "subject", F.lit(" "), "predicate").alias("question"), F.lit("unresolved contradiction blocks verification").alias("why"), F.lit(0.8).alias("value")).distinct()
    return needed.unionByName(asked.join(needed.select("question"), "question", "left_anti")).withColumn("priority", F.lit("high"))


def derived_actions(tests: DataFrame, per: int = 3) -> DataFrame:
    """hypothesis_id, kind, value of at most `per` tests (hypothesis_id, status, kind, priority, seq) of each live hypothesis, highest priority first."""
    order = Window.partitionBy("hypothesis_id").orderBy(F.col("priority").desc(), "seq")
    first = tests.where(~F.col("status").isin(*CLOSED)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per)
    kind = F.when(F.col("kind") == "check_assumption", "collect").otherwise(F.col("kind"))
    return first.select("hypothesis_id", "seq", kind.alias("kind"), F.round(0.4 + 0.2 * F.col("priority"), 3).alias("value"))


def weakest(hypotheses: DataFrame) -> DataFrame:
    """The hypothesis with most assumptions and opposition (n_assumptions, n_oppose), the first in order among equals; none without any."""
    burden = hypotheses.withColumn("load", F.col("n_assumptions") + F.col("n_oppose")).where("load > 0")
    return burden.agg(F.min(F.struct((-F.col("load")).alias("less"), "hypothesis_id", "n_assumptions", "n_oppose")).alias("w")).where("w IS NOT NULL").select("w.hypothesis_id", "w.n_assumptions", "w.n_oppose", (-F.col("w.less")).alias("load"))


def overlay_edges(links: DataFrame, assumptions: DataFrame, required: DataFrame, competing: DataFrame) -> DataFrame:
    """source, kind, target: what supports or opposes a hypothesis, what it assumes and needs (hypothesis_id, nth), what competes (both ways)."""
    own = links.select(F.col("hypothesis_id").alias("source"), F.when(F.col("supports"), "supported_by").otherwise("opposed_by").alias("kind"), F.col("evidence_id").cast("string").alias("target"))
    numbered = lambda rows, kind, word: rows.select(F.col("hypothesis_id").alias("source"), F.lit(kind).alias("kind"), F.concat_ws("-", "hypothesis_id", F.lit(word), F.col("nth").cast("string")).alias("target"))
    pairs = competing.select("left_id", "right_id").union(competing.select("right_id", "left_id")).distinct()
    both = pairs.select(F.col("left_id").alias("source"), F.lit("competes_with").alias("kind"), F.col("right_id").alias("target"))
    return own.unionByName(numbered(assumptions, "depends_on", "assumption")).unionByName(numbered(required, "requires", "missing")).unionByName(both)
