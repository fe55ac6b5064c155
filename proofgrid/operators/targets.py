"""Targets that a text names: web addresses, domains, IP addresses, mail addresses, AS numbers and quoted names.

Spans compete: a URL covers what stands in it, so the others are looked for in what is left; quoted names are taken from the
whole text. Of equal targets (kind, and value in lower case) of a text the first counts. Letters outside ASCII are word
characters, in every engine: they are read as one, so that a domain doesn't begin in the middle of a word.

Nulls, ties and odd input: a null or empty text names nothing; rows that repeat an id are one text's parts; a quoted run of
three to eighty characters is a name, blanks around it dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns by kind, in order.
URL = r"""(?i)https?://[^\s"'<>)\]]+"""
KINDS = {
    "domain": r"(?i)\b((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,})\b",
    "ip_address": r"(\b(?:\d{1,3}\.){3}\d{1,3}\b)",
    "email": r"(\b[\w.+-]+@[\w-]+\.[\w.-]+\b)",
    "asn": r"(?i)(\bAS\d{1,7}\b)",
}
QUOTED = "[\"'“”‘’]([^\"'“”‘’]{3,80})[\"'“”‘’]"
#: Letters beyond ASCII, for which an underscore stands where words are bounded.
LETTERS = "[À-῿Ⰰ-ⷿ぀-힯]"


def spans(text: Column) -> Column:
    """Array of (kind, value) in the order in which they compete."""
    rest = F.regexp_replace(F.regexp_replace(text, URL, " "), LETTERS, "_")
    value = {"domain": lambda v: F.regexp_replace(F.lower(v), r"\.+$", ""), "asn": F.upper}
    named = lambda kind, found: F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), value.get(kind, lambda x: x)(v).alias("value")))
    parts = [named("url", F.regexp_extract_all(text, F.lit(URL), F.lit(0)))]
    parts += [named(kind, F.regexp_extract_all(rest, F.lit(pattern), F.lit(1))) for kind, pattern in KINDS.items()]
    return F.concat(*parts, named("quoted", F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))))


def targets(texts: DataFrame, key: str) -> DataFrame:
    """key, kind, value, n of the different targets of each text (key, text): the value as it first stands, and how often it does."""
    rows = texts.where("text <> ''").select(key, F.posexplode(spans(F.col("text"))).alias("at", "x"))
    found = rows.groupBy(key, "x.kind", F.lower("x.value").alias("lower")).agg(F.min_by("x.value", "at").alias("value"), F.count(F.lit(1)).alias("n"))
    return found.select(key, "kind", "value", "n")


def shared_targets(found: DataFrame, key: str) -> DataFrame:
    """kind, value in lower case, n_texts of targets that two texts or more name."""
    return found.groupBy("kind", F.lower("value").alias("value")).agg(F.countDistinct(key).alias("n_texts")).where("n_texts > 1")
