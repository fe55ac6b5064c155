"""Scores: confidence bands, half-life freshness, hypothesis confidence, indicator freshness."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import age_micros

# Days that an indicator of a type stays live.
TTL_DAYS = {"ipv4": 30, "ipv6": 30, "domain": 60, "fqdn": 60, "url": 45, "md5": 3650, "sha1": 3650, "sha256": 3650}
HASHES = ("md5", "sha1", "sha256")


def freshness(seen: Column, now: dt.datetime, half_life_days: float = 30.0) -> Column:
    """exp(-ln 2 * age / half life); 0.5 for an unknown age."""
    age = F.greatest(age_micros(seen, now) / 86.4e9, F.lit(0.0))
    return F.when(seen.isNull(), 0.5).otherwise(F.exp(age * (-math.log(2) / half_life_days)))


def hypothesis_score(
    strength: Column, independent: Column, temporal: Column, fresh: Column, coverage: Column, entity: Column | None = None, contradiction: Column | None = None, assumptions: Column | None = None, alternative: Column | None = None
) -> Column:
    """Six weighted terms less the penalties for contradiction, assumptions and the best alternative, between 0 and 1."""
    raw = 0.3 * strength + 0.2 * F.least(F.lit(1.0), independent / 3.0) + 0.15 * temporal + 0.15 * (F.lit(1.0) if entity is None else entity) + 0.1 * fresh + 0.05 * coverage
    for weight, part in ((0.1, contradiction), (0.05, None if assumptions is None else F.least(assumptions, F.lit(4))), (0.15, alternative)):
        if part is not None:
            raw = raw - weight * part
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def band(score: Column) -> Column:
    return F.when(score < 0.2, "very_low").when(score < 0.4, "low").when(score < 0.6, "moderate").when(score < 0.8, "high").otherwise("very_high")


def confidence_band(score: Column) -> Column:
    return F.when(score < 0.2, "very_low").when(score < 0.45, "low").when(score < 0.7, "moderate").when(score < 0.9, "high").otherwise("very_high")


def indicator_state(kind: Column, age_days: Column) -> Column:
    ttl = F.lit(None).cast("int")
    for name, days in TTL_DAYS.items():
        ttl = F.when(kind == name, days).otherwise(ttl)
    return F.when(age_days <= ttl * 0.5, "ACTIVE").when(age_days <= ttl, "UNCERTAIN").when(kind.isin(*HASHES), "HISTORICAL").otherwise("STALE")


def next_action_priority(gain: Column, cost: Column, risk: Column, approval: Column) -> Column:
    """Expected gain less cost (over 5, at most 1), risk and approval, 0 at least."""
    # What risk takes off.
    off = F.when(risk == "none", 0.0).when(risk == "low", 0.05).when(risk == "medium", 0.2).when(risk == "high", 0.5).otherwise(0.9)
    return F.greatest(F.lit(0.0), gain - F.least(F.lit(1.0), cost / 5.0) - off - F.when(approval, 0.15).otherwise(0.0))
