"""Payment ledger: dedup by transaction, totals per currency, buckets; identifiers merged by value.

Amounts are whole cents. Entries: tx_key, seq, entry_id, direction, cents, currency, status, state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weakest to strongest.
STATES = ("UNSUPPORTED_STATEMENT", "DISPUTED", "DOCUMENTED", "CORROBORATED")
STATUSES = ("FAILED", "REQUESTED", "ATTEMPTED", "PENDING", "DISPUTED", "REFUNDED", "COMPLETED")
OPEN_STATUSES = ("PENDING", "DISPUTED", "ATTEMPTED", "REQUESTED", "FAILED")


def merged(entries: DataFrame) -> DataFrame:
    """One line a transaction: evidence united, strongest state and status, the amount known from the strongest and newest entry."""
    order = F.array(*map(F.lit, STATES))
    rank = F.array_position(order, F.col("state"))
    status_rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    known = F.when(F.col("cents").isNotNull(), F.struct(rank.alias("rank"), "seq"))
    out = entries.groupBy("tx_key").agg(
        F.min_by("direction", "seq").alias("direction"), F.min_by("currency", "seq").alias("currency"), F.max_by("status", status_rank).alias("status"), F.max_by("state", rank).alias("verification_state"),
        F.max_by("cents", known).alias("cents"), F.countDistinct("entry_id").alias("n_evidence"), (F.count(F.lit(1)) - 1).alias("n_suppressed"),
    )
    return out


def totals(ledger: DataFrame) -> DataFrame:
    """Outflow, returns and net loss per currency; unknown amounts and currencies are counted, never summed."""
    rows = ledger.where("verification_state <> 'UNSUPPORTED_STATEMENT'").withColumn("currency", F.upper("currency"))
    outward, inward = (F.col("direction") == "OUT") & (F.col("status") == "COMPLETED"), (F.col("direction") == "IN") & (F.col("status") == "REFUNDED")
    unknown, nowhere = F.col("cents").isNull(), F.col("cents").isNotNull() & (F.col("currency") == "")
    money = lambda test: F.coalesce(F.sum(F.when(test & (F.col("currency") != ""), F.col("cents"))), F.lit(0))
    sums = rows.groupBy("currency").agg(
        money(outward).alias("outflow"), money(inward).alias("returns"), F.count_if(outward & unknown).alias("unknown_amount_out"), F.count_if(outward & nowhere).alias("unknown_currency_out"),
        F.count_if(inward & unknown).alias("unknown_amount_in"), F.count_if(inward & nowhere).alias("unknown_currency_in"),
    )
    return sums.withColumn("provisional_net_loss", F.col("outflow") - F.col("returns"))


def buckets(ledger: DataFrame) -> DataFrame:
    """Open lines by status."""
    return ledger.where(F.col("status").isin(*OPEN_STATUSES)).groupBy("status").agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))


def identifier_intake(leads: DataFrame) -> DataFrame:
    """Identifiers of equal kind and value (case and blanks aside) are one lead with all their evidence."""
    groups = leads.groupBy("kind", F.lower(F.trim("value")).alias("value")).agg(F.countDistinct("evidence_id").alias("n_evidence"))
    return groups.withColumn("level", F.lit("OBSERVED_IDENTIFIER"))


def noisy_or(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Combined confidence of independent scores: 1 - product(1 - s), the mean and the weakest."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return scores.groupBy(*keys).agg(F.round(1 - F.product(1 - s), 6).alias("noisy_or"), F.round(F.avg(s), 6).alias("mean"), F.round(F.min(s), 6).alias("weakest"))
