"""Rules over records: authorizations, lifecycles, narrative and record checks, merges, escalations, readiness, budgets.

Each is a column or a join with an ordered ladder; nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import first_failing, violations

# Orders, sets and patterns that the rules name.
MODULE_LIFECYCLE = ("missing", "created", "partial", "implemented", "unit_tested", "integration_tested", "live_tested", "validated", "production_qualified")
BLOCKED_RUNS = ("failed", "cancelled", "blocked_input", "blocked_configuration", "blocked_permission", "blocked_budget", "skipped_not_applicable")
QUALIFICATIONS = ("conceptual", "documented", "integration_tested", "production_qualified")
CERTAINTY = r"(?i)\b(proves?|proved|confirmed|certainly|definitely|undoubtedly|is guilty|is owned by|operates)\b"
RISKS = {"direct_probe": "high", "dark": "critical", "credential": "medium"}
REVIEW_TRIGGERS = ("material_identity_attribution", "disputed_evidence", "suspicious_source_instructions", "weakly_supported_conclusion", "consequential_report_claim")
REQUIRED_ATTRIBUTES = {"username": ("value",), "domain": ("value",), "ip_address": ("value",)}
ENDPOINT_KINDS = {"resolves_to": (("domain",), ("ip_address",)), "employs": (("organization",), ("person",)), "exploits": (("threat_actor", "malware"), ("cve",))}
EXPLOITATION = ("mentioned", "possible_exploitation", "reported_exploitation", "independently_supported_exploitation")
SIGNALS = {"sinkholed": "SINKHOLED", "expired_domain": "EXPIRED_DOMAIN", "reassigned_ip": "REASSIGNED_IP", "shared_hosting": "SHARED_HOSTING", "cdn_proxy": "CDN_PROXY"}
GENERIC_MODULES = ("pe", "hash", "math", "string")
COSTS = {"request": 0.002, "model_call": 0.01}


def place(order: tuple[str, ...], value: Column) -> Column:
    """Place in an order from 0; null for other words."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1


def at_least(order: tuple[str, ...], value: Column, minimum: str) -> Column:
    return F.coalesce(place(order, value) >= order.index(minimum), F.lit(False))


def countable(status: Column) -> Column:
    """Whether a run's results count: blocked, skipped and failed runs never do."""
    return ~status.isin(*BLOCKED_RUNS)


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def authorization_valid(granted_by: Column, basis: Column, scopes: Column, expires_at: Column, now: Column) -> Column:
    """Someone granted it on some basis for some scope, and it hasn't run out; without an end it doesn't."""
    return ~blank(granted_by) & ~blank(basis) & (F.size(scopes) > 0) & F.coalesce(now <= expires_at, F.lit(True))


def permits(scopes: Column, activity: Column) -> Column:
    return F.array_contains(scopes, activity) | F.array_contains(scopes, F.lit("*"))


def authorization_reason(valid: Column, scopes: Column, activity: Column, asserted: Column) -> Column:
    """Why collecting is allowed or refused: a valid record decides, else what the caller asserts."""
    open_ = permits(scopes, activity) | F.array_contains(scopes, F.lit("collect.public"))
    return F.when(valid & open_, "valid authorization record").when(valid, "scopes do not permit the activity").when(asserted, "caller asserted authorized scope").otherwise("no valid authorization and no asserted scope")


def in_scope(when: Column, start: Column, end: Column, domain: Column, domains: Column) -> Column:
    """Within the time window (open where it is null) and among the domains (all where there are none)."""
    time = when.isNull() | (F.coalesce(when >= start, F.lit(True)) & F.coalesce(when <= end, F.lit(True)))
    return time & ((F.size(domains) == 0) | F.array_contains(domains, domain))


def narrative_issues(text: Column, kind: Column, cited: Column, hypothesis_id: Column, executive: bool = False) -> Column:
    """Rules that a statement breaks; a blank one breaks that alone."""
    rules = [
        (kind.isin("fact", "inference") & ~cited, "uncited_fact"), ((kind == "hypothesis") & hypothesis_id.isNull(), "orphan_hypothesis"), (kind.isin("hypothesis", "speculation", "unknown") & text.rlike(CERTAINTY), "certainty_mismatch"),
        ((kind == "speculation") & F.lit(executive), "speculation_in_executive"),
    ]
    return F.when(blank(text), F.array(F.lit("empty"))).otherwise(violations(rules))


def task_risk(capability: Column) -> Column:
    return F.coalesce(*[F.when(capability.contains(needle), level) for needle, level in RISKS.items()], F.lit("low"))


def missing_required(kind: Column, attributes: Column) -> Column:
    """Required attributes of a kind that a map lacks or has blank."""
    wanted = F.coalesce(F.try_element_at(F.create_map(*[x for k, names in REQUIRED_ATTRIBUTES.items() for x in (F.lit(k), F.array(*map(F.lit, names)))]), kind), F.array().cast("array<string>"))
    return F.array_except(wanted, F.map_keys(F.map_filter(attributes, lambda _, v: ~blank(v))))


def endpoints_valid(kind: Column, subject_kind: Column, object_kind: Column) -> Column:
    """Whether an edge of a kind may join these kinds; kinds without a rule may join all."""
    tests = [F.when(kind == k, subject_kind.isin(*a) & object_kind.isin(*b)) for k, (a, b) in ENDPOINT_KINDS.items()]
    return F.coalesce(*tests, F.lit(True))


def relation_problems(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges (source, target, kind, source_kind, target_kind, valid_from, valid_to) with problems, by vertices (entity_id)."""
    ids = vertices.select("entity_id").distinct()
    joined = edges.join(ids.select(F.col("entity_id").alias("source"), F.lit(True).alias("has_source")), "source", "left").join(ids.select(F.col("entity_id").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    return edge_problems(joined)


def edge_problems(edges: DataFrame) -> DataFrame:
    """relation_problems of edges that already say whether their ends are known (has_source, has_target: true or null)."""
    rules = [
        (F.col("has_source").isNull(), "unknown source"), (F.col("has_target").isNull(), "unknown target"), (F.coalesce(F.col("valid_from") > F.col("valid_to"), F.lit(False)), "valid_from after valid_to"),
        (~endpoints_valid(F.col("kind"), F.col("source_kind"), F.col("target_kind")), "endpoint kinds"),
    ]
    return edges.withColumn("problems", violations(rules)).drop("has_source", "has_target")


def claim_problems(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, n_unknown (citations of evidence that isn't there), uncited (supported without any) for claims (claim_id, status)."""
    known = evidence.select("evidence_id").distinct().withColumn("known", F.lit(True))
    counts = citations.join(known, "evidence_id", "left").groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("n_unknown"))
    rows = claims.join(counts, "claim_id", "left")
    return rows.select("claim_id", F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), ((F.col("status") == "supported") & (F.coalesce("n", F.lit(0)) == 0)).alias("uncited"))


def indicator_problems(confidence: Column, n_evidence: Column, freshness: Column, n_sources: Column, certainty: Column) -> Column:
    """What makes an indicator or alias unfit: confidence without evidence or with old sightings, confirmation by one source."""
    return violations([
        ((confidence >= 0.7) & (n_evidence == 0), "high confidence without evidence"), ((confidence >= 0.7) & freshness.isin("STALE", "HISTORICAL"), "stale at high confidence"), ((certainty == "confirmed") & (n_sources < 2), "confirmed by fewer than two sources"),
    ])


def alias_certainty(n_sources: Column) -> Column:
    return F.when(n_sources >= 2, "confirmed").when(n_sources == 1, "source_asserted").otherwise("candidate")


def family_merge(names: Column, behaviour: Column, code: Column, config: Column, infrastructure: Column, n_sources: Column) -> Column:
    """Whether two families are one: names or infrastructure alone never say so, code or configuration with behaviour may."""
    strong = F.coalesce(code >= 0.85, F.lit(False)) | F.coalesce(config >= 0.85, F.lit(False))
    return (
        F.when((names >= 0.9) & (behaviour < 0.3) & (F.coalesce(code, F.lit(0.0)) == 0), "likely_different").when(strong & (behaviour >= 0.5) & (n_sources >= 2), "verified_same_family").when(strong & (behaviour >= 0.5), "probable_same_family")
        .when((behaviour >= 0.7) & (n_sources >= 2), "possible_same_family").when(infrastructure & (behaviour < 0.5), "unresolved").when((behaviour < 0.2) & ~strong, "likely_different").otherwise("unresolved")
    )


def exploitation_levels(reports: DataFrame) -> DataFrame:
    """association_id, level, refused for reports (association_id, seq, level, source_id): the strongest level so far.

    The top level counts from the time when two sources have reported anything; refused says that one came too early and none after.
    """
    rows = reports.withColumn("rank", F.coalesce(place(EXPLOITATION, F.col("level")), F.lit(0)))
    firsts = rows.groupBy("association_id", "source_id").agg(F.min("seq").alias("at"))
    earliest = firsts.groupBy("association_id").agg(F.min_by("source_id", "at").alias("first_source"))
    second = firsts.join(earliest, "association_id").where("source_id <> first_source").groupBy("association_id").agg(F.min("at").alias("second_at"))
    top = len(EXPLOITATION) - 1
    sums = rows.join(second, "association_id", "left").groupBy("association_id").agg(
        F.max(F.when(F.col("rank") < top, F.col("rank"))).alias("below"), F.bool_or(F.col("rank") == top).alias("asked"), F.coalesce(F.bool_or((F.col("rank") == top) & (F.col("seq") >= F.col("second_at"))), F.lit(False)).alias("reached")
    )
    level = F.when(F.col("reached"), top).otherwise(F.coalesce("below", F.lit(0)))
    return sums.select("association_id", F.element_at(F.array(*map(F.lit, EXPLOITATION)), (level + 1).cast("int")).alias("level"), (F.col("asked") & ~F.col("reached")).alias("refused"))


def rule_breadth(n_strings: Column, heuristic: Column, modules: Column) -> Column:
    """How broad a detection rule is, 0 to 1: few strings, heuristics, generic modules."""
    generic = F.arrays_overlap(F.transform(modules, F.lower), F.array(*map(F.lit, GENERIC_MODULES))) & (n_strings <= 3)
    part = lambda test, weight: F.when(test, weight).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), part((n_strings > 0) & (n_strings <= 2), 0.5) + part(heuristic, 0.3) + part(generic, 0.2)), 6)


#: A detection rule is validated first, then approved by someone, and never deployed by itself.
DEPLOYMENT = {"imported": ("validated",), "validated": ("approved_for_deployment",), "approved_for_deployment": ()}


def signalled_freshness(indicators: DataFrame, signals: DataFrame) -> DataFrame:
    """indicators (ioc_id, freshness) whose state the last known signal (ioc_id, seq, signal) overrides; live says whether one may be blocked on."""
    table = F.create_map(*[x for k, v in SIGNALS.items() for x in (F.lit(k), F.lit(v))])
    last = signals.withColumn("state", F.try_element_at(table, F.col("signal"))).where("state IS NOT NULL").groupBy("ioc_id").agg(F.max_by("state", "seq").alias("state"))
    state = F.coalesce("state", "freshness")
    return indicators.join(last, "ioc_id", "left").select("ioc_id", state.alias("freshness"), (state == "ACTIVE").alias("live"), state.isin("SHARED_HOSTING", "CDN_PROXY").alias("weak_pivot"))


def qualified(sources: DataFrame) -> DataFrame:
    """capability, need, n, n_wired, first_source: the sources of a capability that reach a qualification, at most one row for each of both."""
    offered = sources.select("slug", "order", "wired", place(QUALIFICATIONS, F.col("qualification")).alias("rank"), F.explode("capabilities").alias("capability"))
    first = F.min(F.when(F.col("wired") & F.col("order").isNotNull(), F.struct("order", "slug")))
    ranks = offered.where("rank IS NOT NULL").groupBy("capability", "rank").agg(F.count(F.lit(1)).alias("n"), F.count_if("wired").alias("n_wired"), first.alias("first"))
    reached = ranks.withColumn("need", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rank").cast("long"))))
    return reached.groupBy("capability", "need").agg(F.sum("n").alias("n"), F.sum("n_wired").alias("n_wired"), F.min("first")["slug"].alias("first_source"))


def readiness(requirements: DataFrame, sources: DataFrame) -> DataFrame:
    """module_id, capability, satisfied, reason, first_source for requirements (module_id, capability, required, least) by sources (slug, order, capabilities, qualification, wired).

    Requirements meet the sums of their capability's sources, never the sources themselves.
    """
    asked = requirements.select("module_id", "capability", "required", place(QUALIFICATIONS, F.col("least")).cast("long").alias("need"))
    rows = asked.join(qualified(sources), ["capability", "need"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("n_wired", F.coalesce("n_wired", F.lit(0)))
    reason = F.coalesce(first_failing([(F.col("required") & (F.col("n") == 0), "no source qualifies"), (F.col("required") & (F.col("n_wired") == 0), "no connector is wired")]), F.lit(""))
    return rows.select("module_id", "capability", (~F.col("required") | (F.col("n_wired") > 0)).alias("satisfied"), reason.alias("reason"), "first_source")


def module_readiness(items: DataFrame) -> DataFrame:
    return items.groupBy("module_id").agg(F.bool_and("satisfied").alias("ready"), F.count_if(~F.col("satisfied")).alias("n_blocked"))


def needs_review(task_class: Column, triggers: Column) -> Column:
    return task_class.isin(*REVIEW_TRIGGERS) | F.arrays_overlap(triggers, F.array(*map(F.lit, REVIEW_TRIGGERS)))


def objective_problems(question: Column, depth: Column, dark: Column) -> Column:
    return violations([(blank(question), "no canonical question"), (depth > 6, "depth too large"), (dark, "dark sources need approval")])


def blocking_questions(ambiguities: Column, authorized: Column, n_targets: Column) -> Column:
    """What has to be answered before planning."""
    return F.concat(F.coalesce(ambiguities, F.array().cast("array<string>")), violations([(~authorized, "authorization required"), (n_targets == 0, "no concrete target")]))


def budget_states(entries: DataFrame, limits: dict[str, float]) -> DataFrame:
    """case_id, spent, held, tokens, tasks, remaining, exhausted for entries (case_id, kind: settled, held or released; usd, tokens); limits: usd, tokens, tasks."""
    settled = F.col("kind") == "settled"
    sums = entries.groupBy("case_id").agg(
        F.round(F.coalesce(F.sum(F.when(settled, F.col("usd"))), F.lit(0.0)), 4).alias("spent"), F.round(F.coalesce(F.sum(F.when(F.col("kind") == "held", F.col("usd"))), F.lit(0.0)), 4).alias("held"), F.coalesce(F.sum(F.when(settled, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count_if(settled).alias("tasks")
    )
    over = (F.col("spent") + F.col("held") >= limits["usd"]) | (F.col("tokens") >= limits["tokens"]) | (F.col("tasks") >= limits["tasks"])
    return sums.withColumn("remaining", F.round(limits["usd"] - F.col("spent") - F.col("held"), 4)).withColumn("exhausted", over)


def plan_cost(tasks: Column, paid_sources: Column, model_calls: Column) -> Column:
    return F.round(paid_sources * COSTS["request"] * tasks + model_calls * COSTS["model_call"], 4)
