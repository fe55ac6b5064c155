"""Cases: quarantined and corrected payments, versions of a timeline, attribution by rungs, gaps and their ranking.

Everything is found by keys and aggregates, never by going through a case's records one by one: a correction is a row that
replaces another, a rung is reached at the first good request after the rung below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .review import first_failing

# Rungs of an attribution, and signals that carry none by themselves.
RUNGS = ("OBSERVED_IDENTIFIER", "CLAIMED_IDENTITY", "CANDIDATE_ASSOCIATION", "CORROBORATED_ATTRIBUTION")
WEAK_SIGNALS = ("shared_ip", "shared_hosting", "shared_certificate", "same_asn", "similar_name", "same_registrar", "template_website")
# Places of the words by which gaps are ranked; others come last.
GAP_PLACES = {"HIGH": 0, "KNOWN_SOURCE": 0, "EASY": 0, "MEDIUM": 1, "LOW": 2, "PAID": 2, "CONFIGURATION_BLOCKED": 3, "UNKNOWN": 4, "NONE": 0, "PRIVACY": 1, "LEGAL_REVIEW": 2}


def transaction_key(tx_ref: Column, direction: Column, amount: Column, currency: Column, day: Column, recipient: Column, method: Column) -> Column:
    """The reference if there is one, else what else names a payment; other days are other payments."""
    known = F.coalesce(F.trim(tx_ref), F.lit("")) != ""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fields = [direction, text(amount), F.upper(text(currency)), text(day), F.lower(F.trim(text(recipient))), F.lower(text(method))]
    return F.when(known, F.concat(F.lit("txref:"), F.lower(F.trim(tx_ref)))).otherwise(F.concat_ws("|", F.lit("fields"), *fields))


def fingerprint(columns: list[Column]) -> Column:
    """A hash of a payment's content, equal for entries that differ only in ids, evidence and notes."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def corrected(entries: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with the last correction of each (entry_id, seq, tx_key) applied, and the audit of what they were: entry_id, before_key, after_key, merged."""
    last = corrections.groupBy("entry_id").agg(F.max_by("tx_key", "seq").alias("new_key"))
    joined = entries.join(last, "entry_id", "left")
    moved = joined.withColumn("tx_key", F.coalesce("new_key", "tx_key")).drop("new_key")
    # an entry merges where its new key has other entries
    sizes = moved.groupBy(F.col("tx_key").alias("new_key")).agg(F.count(F.lit(1)).alias("n"))
    changed = joined.where("new_key IS NOT NULL AND new_key <> tx_key").select("entry_id", F.col("tx_key").alias("before_key"), "new_key")
    audit = changed.join(sizes, "new_key").select("entry_id", "before_key", F.col("new_key").alias("after_key"), (F.col("n") > 1).alias("merged"))
    return moved, audit


def quarantined(ledger: DataFrame) -> DataFrame:
    """tx_key, kind, cents, currency of what never enters totals: displayed balances, and claims without a document."""
    kinds = F.array(F.when(F.col("direction") == "DISPLAY_ONLY", "displayed_balance"), F.when(F.col("verification_state") == "UNSUPPORTED_STATEMENT", "statement_only"))
    return ledger.select("tx_key", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), "cents", "currency")


def history(events: DataFrame, key: list[str]) -> DataFrame:
    """events (event_id, event_time, seq and key) with version, superseded_by and place: each key's later events correct its earlier ones.

    Nothing is dropped; undated events come last in `place`, which is per case_id.
    """
    versions = Window.partitionBy(*key).orderBy("seq")
    order = Window.partitionBy("case_id").orderBy(F.col("event_time").asc_nulls_last(), "seq")
    return events.withColumn("version", F.row_number().over(versions)).withColumn("superseded_by", F.lead("event_id").over(versions)).withColumn("place", F.row_number().over(order))


def contradicting(events: DataFrame) -> DataFrame:
    """first_id, second_id of current events (event_id, superseded_by, contradicts array) that contradict each other, each pair once."""
    current = events.where("superseded_by IS NULL")
    named = current.select(F.col("event_id").alias("a"), F.explode("contradicts").alias("b")).where("a <> b")
    both = named.join(current.select(F.col("event_id").alias("b")), "b", "left_semi")
    return both.select(F.least("a", "b").alias("first_id"), F.greatest("a", "b").alias("second_id")).distinct()


def within(events: DataFrame, time: Column, start, end) -> DataFrame:
    """Events whose effective time is in [start, end]; open ends hold everything, undated events are outside."""
    kept = time.isNotNull()
    if start is not None:
        kept = kept & (time >= start)
    if end is not None:
        kept = kept & (time <= end)
    return events.where(kept)


def promotions(requests: DataFrame) -> DataFrame:
    """request_id, lead_id, accepted, reason, limited for requests (lead_id, seq, target, signals, n_evidence, n_independent).

    A lead climbs one rung at a time. The first good request for the first rung counts, then the first good one for the
    second after that, and so on; every request is judged by the rungs reached before it.
    """
    target = F.array_position(F.array(*map(F.lit, RUNGS)), F.col("target")) - 1
    strong = F.size(F.array_except("signals", F.array(*map(F.lit, WEAK_SIGNALS)))) > 0
    good = (F.col("n_evidence") > 0) & strong & ((F.col("target") != RUNGS[-1]) | (F.col("n_independent") >= 2))
    weak = F.arrays_overlap("signals", F.array(*map(F.lit, WEAK_SIGNALS)))
    # what a request is, without its rungs, is a number; names and signals aren't moved
    lacks = F.when(F.col("n_evidence") == 0, 0).when(~strong, 1).when((F.col("target") == RUNGS[-1]) & (F.col("n_independent") < 2), 2)
    rows = requests.select("request_id", "lead_id", "seq", target.cast("int").alias("rung"), lacks.alias("lacks"), weak.alias("weak"), good.alias("good")).where("lead_id IS NOT NULL")
    reached = rows.where("good AND rung = 1").groupBy("lead_id").agg(F.min("seq").alias("at1"))
    for k in range(2, len(RUNGS)):
        after = rows.where(f"good AND rung = {k}").select("lead_id", "seq").join(reached.select("lead_id", F.col(f"at{k - 1}").alias("before")), "lead_id").where("seq > before")
        reached = reached.join(after.groupBy("lead_id").agg(F.min("seq").alias(f"at{k}")), "lead_id", "left")
    judged = rows.join(reached, "lead_id", "left")
    level = reduce(lambda a, b: a + b, [F.when(F.col(f"at{k}") < F.col("seq"), 1).otherwise(0) for k in range(1, len(RUNGS))])
    said = F.array(*map(F.lit, ("abstain_no_evidence", "non_discriminating_signal_only", "corroboration_requires_2_independent_sources")))
    reason = F.coalesce(first_failing([
        (F.col("rung") < 0, "unknown_level"), (F.col("rung") <= F.col("level"), "not_a_promotion"), (F.col("rung") > F.col("level") + 1, "cannot_skip_ladder_rungs"),
    ]), F.get(said, F.col("lacks")), F.lit("promoted"))
    return judged.withColumn("level", level).withColumn("reason", reason).select("request_id", "lead_id", (F.col("reason") == "promoted").alias("accepted"), "reason", ((F.col("reason") == "promoted") & F.col("weak")).alias("limited"))


def attribution_levels(requests: DataFrame, judged: DataFrame) -> DataFrame:
    """lead_id, level, unresolved after all requests."""
    won = judged.where("accepted").groupBy("lead_id").agg(F.count(F.lit(1)).alias("n"))
    level = F.element_at(F.array(*map(F.lit, RUNGS)), (F.coalesce("n", F.lit(0)) + 1).cast("int"))
    return requests.select("lead_id").distinct().join(won, "lead_id", "left").select("lead_id", level.alias("level"), (level != RUNGS[-1]).alias("unresolved"))


def case_gaps(facts: DataFrame) -> DataFrame:
    """case_id, gap, n and the words it ranks by, for the counts of a case.

    facts: case_id, unsupported, unresolved_amounts, displayed, withdrawals, inward, unresolved_leads, dated.
    """
    c = F.col
    gap = lambda test, name, n, relevance, expected, access="UNKNOWN": F.when(test, F.struct(F.lit(name).alias("gap"), n.cast("long").alias("n"), F.lit(relevance).alias("relevance"), F.lit(expected).alias("expected_new_info"), F.lit(access).alias("accessibility"), F.lit("FREE").alias("cost"), F.lit("NONE").alias("risk")))
    rules = F.array(
        gap(c("unsupported") > 0, "statement_only_payments", c("unsupported"), "HIGH", "HIGH"), gap(c("unresolved_amounts") > 0, "unresolved_amounts", c("unresolved_amounts"), "HIGH", "HIGH"), gap(c("displayed") > 0, "displayed_balances", c("displayed"), "MEDIUM", "MEDIUM"),
        gap((c("withdrawals") > 0) & (c("inward") == 0), "withdrawals_without_returns", c("withdrawals"), "HIGH", "HIGH"), gap(c("unresolved_leads") > 0, "unresolved_attribution", c("unresolved_leads"), "HIGH", "MEDIUM", "KNOWN_SOURCE"), gap(c("dated") == 0, "no_dated_events", F.lit(1), "HIGH", "HIGH"),
    )
    found = facts.select("case_id", F.posexplode(F.filter(rules, lambda g: g.isNotNull())).alias("seq", "g"))
    return found.select("case_id", "seq", "g.*")


def ranked_gaps(gaps: DataFrame) -> DataFrame:
    """gaps with place: relevance, then expected new information, accessibility, cost, risk; ties keep their order (seq)."""
    places = F.create_map(*[x for k, v in GAP_PLACES.items() for x in (F.lit(k), F.lit(v))])
    by = [F.coalesce(F.try_element_at(places, F.col(c)), F.lit(9)) for c in ("relevance", "expected_new_info", "accessibility", "cost", "risk")]
    return gaps.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(*by, "seq")))
