"""Queries over cases: corrected and quarantined payments, timeline versions, attribution, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases, ledger
from ..sources.adapters import CURRENCY, TWINS, payments
from ..sources.tables import read


def ledger_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.quarantined(ledger.merged(payments(spark, sf_dir)))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with ids of their own."""
    rows = payments(spark, sf_dir)
    return rows.withColumn("entry_id", F.concat_ws(":", "tx_key", "entry_id", F.coalesce(F.col("cents").cast("string"), F.lit(""))))


def corrections(entries: DataFrame) -> DataFrame:
    """Second lines of an order belong to the transaction of their part."""
    return entries.where("seq.l_linenumber = 2").select("entry_id", "seq", F.concat(F.lit("txref:"), F.col("seq.l_partkey").cast("string")).alias("tx_key"))


def corrected_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after each second line of an order was found to belong to another transaction."""
    entries = numbered(spark, sf_dir)
    moved, _ = cases.corrected(entries, corrections(entries))
    return ledger.merged(moved).select("tx_key", "cents", "status", "verification_state", "n_evidence", "n_suppressed")


def correction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = numbered(spark, sf_dir)
    _, audit = cases.corrected(entries, corrections(entries))
    return audit.distinct()


def payment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each way of naming a payment brings together: lines of a fifth line number have no reference."""
    lines = read(spark, sf_dir, "lineitem")
    ref = F.when(F.col("l_linenumber") % 5 != 0, F.concat(F.lit(" TX"), F.col("l_orderkey").cast("string")))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    key = cases.transaction_key(ref, F.col("l_returnflag"), cents, F.lit("usd"), day, F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")), F.lit("WIRE"))
    print_ = cases.fingerprint([F.col("l_returnflag"), cents, F.lit("usd"), day, F.col("l_suppkey")])
    return lines.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(print_).alias("fingerprint"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user, kind and day correct one another; each 97th is undated and each contradicts two others."""
    rows = read(spark, sf_dir, "events")
    return rows.select(
        F.col("user_id").alias("case_id"), "event_id", F.col("event_id").alias("seq"), "event_type", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("event_time"),
        F.array(F.col("event_id") + 7, F.floor(F.col("event_id") / 2)).alias("contradicts"),
    )


def timeline_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.history(timeline(spark, sf_dir), ["case_id", "event_type", "day"]).select("case_id", "event_id", "version", "superseded_by", "place")


def timeline_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.contradicting(cases.history(timeline(spark, sf_dir), ["case_id", "event_type", "day"]))


def timeline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir)
    kept = cases.within(rows, F.col("event_time"), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))
    return kept.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to promote their user's lead."""
    e = F.col("event_id")
    target = F.element_at(F.array(*map(F.lit, cases.RUNGS)), (F.floor(e / 3) % 4 + 1).cast("int"))
    signals = F.when(e % 3 == 0, F.array(F.lit("shared_ip"))).when(e % 3 == 1, F.array(F.lit("shared_ip"), F.lit("same_wallet"))).otherwise(F.array(F.lit("same_wallet")))
    return read(spark, sf_dir, "events").select(e.alias("request_id"), F.col("user_id").alias("lead_id"), e.alias("seq"), target.alias("target"), signals.alias("signals"), (e % 4).alias("n_evidence"), (F.floor(F.col("value")) % 4).alias("n_independent"))


def attribution_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.promotions(requests(spark, sf_dir))


def attribution_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir)
    return cases.attribution_levels(rows, cases.promotions(rows))


def case_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each currency of payments: its ledger, the events of every fifth user, and those users' leads."""
    ledger_rows = ledger.merged(payments(spark, sf_dir)).withColumn("case_id", F.upper("currency"))
    money = ledger_rows.groupBy("case_id").agg(
        F.count_if(F.col("verification_state") == "UNSUPPORTED_STATEMENT").alias("unsupported"), F.count_if(F.col("cents").isNull() | (F.col("currency") == "")).alias("unresolved_amounts"), F.count_if(F.col("direction") == "DISPLAY_ONLY").alias("displayed"), F.count_if(F.col("direction") == "IN").alias("inward")
    )
    case_of = F.element_at(F.array(*map(F.lit, CURRENCY)), (F.col("user") % 5 + 1).cast("int"))
    events = timeline(spark, sf_dir).withColumn("user", F.col("case_id")).groupBy(case_of.alias("case_id")).agg(F.count_if(F.col("event_type") == "error").alias("withdrawals"), F.count("event_time").alias("dated"))
    leads = attribution_levels(spark, sf_dir).withColumn("user", F.col("lead_id")).groupBy(case_of.alias("case_id")).agg(F.count_if("unresolved").alias("unresolved_leads"))
    facts = money.join(events, "case_id", "full_outer").join(leads, "case_id", "full_outer").na.fill(0)
    return cases.ranked_gaps(cases.case_gaps(facts)).select("case_id", "place", "gap", "n")


QUERIES = {f.__name__: f for f in (ledger_quarantine, corrected_ledger, correction_audit, payment_keys, timeline_history, timeline_contradictions, timeline_window, attribution_promotions, attribution_levels, case_gaps)}

_RANKED = """, numbered AS (SELECT *, tx_key || ':' || entry_id || ':' || coalesce(cents::VARCHAR, '') AS id, CASE WHEN seq.a = 2 THEN 'txref:' || seq.b END AS new_key FROM entries),
    moved AS (SELECT * REPLACE (coalesce(new_key, tx_key) AS tx_key), tx_key AS old_key FROM numbered) """
_HISTORY = """WITH h AS (SELECT user_id AS case_id, event_id, row_number() OVER v AS version, lead(event_id) OVER v AS superseded_by,
    row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 97 <> 0 THEN ts END ASC NULLS LAST, event_id) AS place FROM events WINDOW v AS (PARTITION BY user_id, event_type, ts::DATE ORDER BY event_id)) """
_LADDER = f"""WITH RECURSIVE q AS (SELECT event_id AS id, user_id AS lead, event_id // 3 % 4 AS rung, event_id % 3 AS s, event_id % 4 AS ev, floor(value)::BIGINT % 4 AS ind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT DISTINCT lead, 0::BIGINT AS k, 0::BIGINT AS level, NULL::BIGINT AS id, NULL::VARCHAR AS reason, NULL::BIGINT AS s FROM q
      UNION ALL SELECT q.lead, q.k, CASE WHEN x.reason = 'promoted' THEN q.rung ELSE r.level END, q.id, x.reason, q.s FROM r JOIN q ON q.lead = r.lead AND q.k = r.k + 1,
        LATERAL (SELECT CASE WHEN q.rung <= r.level THEN 'not_a_promotion' WHEN q.rung > r.level + 1 THEN 'cannot_skip_ladder_rungs' WHEN q.ev = 0 THEN 'abstain_no_evidence' WHEN q.s = 0 THEN 'non_discriminating_signal_only'
          WHEN q.rung = 3 AND q.ind < 2 THEN 'corroboration_requires_2_independent_sources' ELSE 'promoted' END AS reason) x),
    levels AS (SELECT lead AS lead_id, ({list(cases.RUNGS)})[max(level) + 1] AS level, max(level) < 3 AS unresolved FROM r GROUP BY 1) """
ORACLES = {
    "ledger_quarantine": TWINS["payments"] + "SELECT tx_key, 'displayed_balance' AS kind, cents, currency FROM merged WHERE direction = 'DISPLAY_ONLY' UNION ALL SELECT tx_key, 'statement_only', cents, currency FROM merged WHERE verification_state = 'UNSUPPORTED_STATEMENT'",
    "corrected_ledger": TWINS["payments"] + _RANKED + """, k AS (SELECT *, list_position(['UNSUPPORTED_STATEMENT', 'DISPUTED', 'DOCUMENTED', 'CORROBORATED'], state) AS state_rank, list_position(['FAILED', 'REQUESTED', 'ATTEMPTED', 'PENDING', 'DISPUTED', 'REFUNDED', 'COMPLETED'], status) AS status_rank FROM moved)
        SELECT tx_key, arg_max(cents, {'r': state_rank, 's': seq}) FILTER (cents IS NOT NULL) AS cents, (['FAILED', 'REQUESTED', 'ATTEMPTED', 'PENDING', 'DISPUTED', 'REFUNDED', 'COMPLETED'])[max(status_rank)] AS status,
        (['UNSUPPORTED_STATEMENT', 'DISPUTED', 'DOCUMENTED', 'CORROBORATED'])[max(state_rank)] AS verification_state, count(DISTINCT id) AS n_evidence, count(*) - 1 AS n_suppressed FROM k GROUP BY tx_key""",
    "correction_audit": TWINS["payments"] + _RANKED + ", n AS (SELECT tx_key, count(*) AS n FROM moved GROUP BY 1) SELECT DISTINCT id AS entry_id, old_key AS before_key, new_key AS after_key, n > 1 AS merged FROM moved JOIN n USING (tx_key) WHERE new_key <> old_key",
    "payment_keys": """SELECT CASE WHEN l_linenumber % 5 <> 0 THEN 'txref:tx' || l_orderkey ELSE 'fields|' || l_returnflag || '|' || round(l_extendedprice * 100)::BIGINT || '|USD|' || strftime(l_shipdate, '%Y-%m-%d') || '|supplier ' || l_suppkey || '|wire' END AS key,
        count(*) AS n, min(sha256(l_returnflag || '|' || round(l_extendedprice * 100)::BIGINT || '|usd|' || strftime(l_shipdate, '%Y-%m-%d') || '|' || l_suppkey)) AS fingerprint FROM lineitem GROUP BY 1""",
    "timeline_history": _HISTORY + "SELECT case_id, event_id, version::INTEGER AS version, superseded_by, place::INTEGER AS place FROM h",
    "timeline_contradictions": _HISTORY + """, c AS (SELECT event_id FROM h WHERE superseded_by IS NULL), n AS (SELECT event_id AS a, unnest([event_id + 7, event_id // 2]) AS b FROM c)
        SELECT DISTINCT least(a, b) AS first_id, greatest(a, b) AS second_id FROM n JOIN c ON b = c.event_id WHERE a <> b""",
    "timeline_window": "SELECT user_id AS case_id, count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM events WHERE event_id % 97 <> 0 AND ts >= '2024-01-05' AND ts <= '2024-01-12' GROUP BY 1",
    "attribution_promotions": _LADDER + "SELECT id AS request_id, lead AS lead_id, reason = 'promoted' AS accepted, reason, reason = 'promoted' AND s < 2 AS limited FROM r WHERE k > 0",
    "attribution_levels": _LADDER + "SELECT * FROM levels",
    "case_gaps": TWINS["payments"].replace("WITH entries", _LADDER.replace("WITH RECURSIVE q", "WITH RECURSIVE q", 1) + ", entries", 1) + f""", money AS (SELECT upper(currency) AS case_id, count_if(verification_state = 'UNSUPPORTED_STATEMENT') AS u, count_if(cents IS NULL OR currency = '') AS a, count_if(direction = 'DISPLAY_ONLY') AS d, count_if(direction = 'IN') AS i FROM merged GROUP BY 1),
        ev AS (SELECT ({list(CURRENCY)})[user_id % 5 + 1] AS case_id, count_if(event_type = 'error') AS w, count_if(event_id % 97 <> 0) AS dated FROM events GROUP BY 1), ld AS (SELECT ({list(CURRENCY)})[lead_id % 5 + 1] AS case_id, count_if(unresolved) AS l FROM levels GROUP BY 1),
        f AS (SELECT case_id, coalesce(u, 0) AS u, coalesce(a, 0) AS a, coalesce(d, 0) AS d, coalesce(i, 0) AS i, coalesce(w, 0) AS w, coalesce(dated, 0) AS dated, coalesce(l, 0) AS l FROM money FULL JOIN ev USING (case_id) FULL JOIN ld USING (case_id)),
        g AS (SELECT case_id, 0 AS s, 'statement_only_payments' AS gap, u AS n, 0 AS r1, 0 AS r2, 4 AS r3 FROM f WHERE u > 0 UNION ALL SELECT case_id, 1, 'unresolved_amounts', a, 0, 0, 4 FROM f WHERE a > 0 UNION ALL SELECT case_id, 2, 'displayed_balances', d, 1, 1, 4 FROM f WHERE d > 0
          UNION ALL SELECT case_id, 3, 'withdrawals_without_returns', w, 0, 0, 4 FROM f WHERE w > 0 AND i = 0 UNION ALL SELECT case_id, 4, 'unresolved_attribution', l, 0, 1, 0 FROM f WHERE l > 0 UNION ALL SELECT case_id, 5, 'no_dated_events', 1, 0, 0, 4 FROM f WHERE dated = 0)
        SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY r1, r2, r3, s)::INTEGER AS place, gap, n::BIGINT AS n FROM g""",
}
