"""Rules over records, each an ordered ladder of tests: claims, hypotheses, grants, access, actions, source readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failing(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules])


def violations(rules: list[tuple[Column, str]]) -> Column:
    """The names of all rules that hold."""
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda x: x.isNotNull())


def claim_review(claims: DataFrame) -> DataFrame:
    """claim_id, reason (why it is unsupported), claim_class by the distinct evidence cited."""
    blank, withdrawn = F.trim(F.coalesce("statement", F.lit(""))) == "", F.col("status").isin("refuted", "withdrawn")
    cited = F.size(F.array_distinct(F.coalesce("citations", F.array().cast("array<string>"))))
    reason = first_failing([(blank, "empty statement"), (cited == 0, "no citations"), (withdrawn, "withdrawn")])
    kind = F.when(cited == 0, "UNSUPPORTED").when(withdrawn, "DISPUTED").when(cited >= 2, "SUPPORTED").otherwise("PARTIALLY_SUPPORTED")
    return claims.select("claim_id", reason.alias("reason"), kind.alias("claim_class"))


def hypothesis_review(hypotheses: DataFrame, facts: DataFrame) -> DataFrame:
    """hypothesis_id, problems: rules that keep it from being admitted; supporting refs must be gated facts (fact_id) or named fact_.

    A falsification is a condition with a test at the same place of falsification_tests; without gated facts a hypothesis
    has to declare what opposes it or what is unknown.
    """
    empty = F.array().cast("array<string>")
    given = lambda c: F.coalesce(F.col(c), empty) if c in hypotheses.columns else empty
    refs = hypotheses.select("hypothesis_id", F.explode(F.concat(given("supporting_fact_ids"), given("opposing_fact_ids"))).alias("fact_id")).where(~F.startswith("fact_id", F.lit("fact_")))
    loose = refs.join(facts.select("fact_id").distinct(), "fact_id", "left_anti").groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("n_loose"))
    joined = hypotheses.join(loose, "hypothesis_id", "left")
    none = lambda c: F.size(given(c)) == 0
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    gated = F.lit(not facts.isEmpty())
    untested = F.exists(given("falsifications"), blank)
    if "falsification_tests" in hypotheses.columns:
        untested = untested | (F.size(given("falsification_tests")) < F.size(given("falsifications"))) | F.exists(given("falsification_tests"), blank)
    rules = [
        (~gated & none("opposing_fact_ids") & none("unknowns"), "no gated facts, and neither opposition nor unknowns declared"), (blank(F.col("statement")), "empty statement"), (none("falsifications"), "no falsification condition"),
        (untested, "falsification without condition or test"), (blank(F.col("next_test")), "no next test"), (none("alternative_explanations"), "no alternative explanation"), (F.coalesce("n_loose", F.lit(0)) > 0, "refers to facts that were not gated"),
    ]
    return joined.select("hypothesis_id", violations(rules).alias("problems"))


def recommended_status(rows: DataFrame) -> DataFrame:
    """hypothesis_id, score, status for ACH counts (case_id, consistent, inconsistent, neutral, unknown, falsified)."""
    score = F.round((F.col("consistent") - 2 * F.col("inconsistent")) / F.greatest(F.lit(1), F.col("consistent") + F.col("inconsistent") + F.col("neutral")), 3)
    case = Window.partitionBy("case_id")
    scored = rows.withColumn("score", score).withColumn("best", F.max("score").over(case)).withColumn("n_best", F.sum((F.col("score") == F.col("best")).cast("int")).over(case))
    second = F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).over(case)
    other = F.when((F.col("score") < F.col("best")) | (F.col("n_best") > 1), F.col("best")).otherwise(second)
    status = (
        F.when(F.col("falsified"), "falsified").when((F.col("inconsistent") > 0) & (other.isNull() | (F.col("score") < other)), "weakened").when((F.col("consistent") > 0) & (F.col("inconsistent") == 0), "strengthened")
        .when((F.col("unknown") > 0) & (F.col("consistent") + F.col("inconsistent") + F.col("neutral") == 0), "inconclusive").otherwise("active")
    )
    return scored.withColumn("status", status).select("hypothesis_id", "score", "status")


def grant_decisions(requests: DataFrame, grants: DataFrame, now: float) -> DataFrame:
    """request_id, allowed, reason: default deny by grant, its life and its tools; times are epoch seconds."""
    known = grants.select("grant_id", "allowed_tools", "issued_at", "ttl_seconds", "revoked", F.lit(True).alias("known"))
    joined = requests.join(known, "grant_id", "left")
    live = ~F.col("revoked") & ((F.lit(now) - F.col("issued_at")) < F.col("ttl_seconds"))
    reason = F.coalesce(first_failing([(F.col("known").isNull(), "unknown_grant"), (~live, "grant_expired_or_revoked"), (~F.array_contains("allowed_tools", F.col("tool")), "tool_not_granted")]), F.lit("granted"))
    return joined.select("request_id", (reason == "granted").alias("allowed"), reason.alias("reason"))


def tenant_allowed(request_tenant: Column, case_tenant: Column) -> Column:
    """Records of the default tenant are for it alone; others for their own."""
    ours = F.coalesce(case_tenant, F.lit("")).isin("", "default")
    return F.when(ours, F.coalesce(request_tenant, F.lit("")).isin("", "default")).otherwise(F.coalesce(request_tenant == case_tenant, F.lit(False)))


def action_allowed(action: Column, allowed: Column, prohibited: Column) -> Column:
    """What is prohibited stays so, whatever is allowed."""
    return ~F.coalesce(F.array_contains(prohibited, action), F.lit(False)) & F.coalesce(F.array_contains(allowed, action), F.lit(False))


def source_choice(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """target, capability, slug: for each wanted capability the first source (by order) that has it; null if none."""
    offered = sources.select("slug", "order", F.explode("capabilities").alias("capability")).groupBy("capability").agg(F.min_by("slug", "order").alias("slug"))
    return targets.join(offered, "capability", "left").select("target", "capability", "slug")


def evidence_gaps(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected capabilities (case_id, capability) without any observation that has evidence."""
    return expected.join(observed.where("evidence_id IS NOT NULL").select("case_id", "capability").distinct(), ["case_id", "capability"], "left_anti")
