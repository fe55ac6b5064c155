"""Queries of many patterns: passages of a watch list in documents, behaviours in reports of users' events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patterns
from ..sources.tables import read


def watched_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the second to fifth word of a benchmark item, whatever stands between them."""
    word = F.transform(F.slice(F.split(F.trim("text"), r"\s+"), 2, 4), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1"))
    items = read(spark, sf_dir, "benchmark").where(F.size(F.split(F.trim("text"), r"\s+")) >= 5).select(F.col("item_id").alias("pattern_id"), F.array_join(word, r"\s+").alias("pattern"))
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return patterns.matches(texts, items).select(F.col("text_id").alias("doc_id"), F.col("pattern_id").alias("item_id"))


#: What an event's report says, by type.
REPORTS = {
    "view": "saw vmware and VBOX at start", "click": "Scheduled Task made, then schtasks run", "signup": "powershell -enc was called to create mutex", "purchase": "exfiltration over c2 after http post beacon", "error": "no behaviour, powershellx",
}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.create_map(*[F.lit(x) for pair in REPORTS.items() for x in pair]), F.col("event_type"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("text_id"), F.col("user_id").alias("owner"), F.concat(said, F.lit(" at "), "props").alias("text"))


def behaviour_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report and the behaviours it hints at."""
    known = patterns.behaviours(spark)
    found = patterns.matches(reports(spark, sf_dir), known)
    return found.join(F.broadcast(known), "pattern_id").select(F.col("text_id").alias("event_id"), "technique", "tactic", F.lower("first").alias("first"))


def behaviour_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, said = patterns.behaviours(spark), reports(spark, sf_dir)
    return patterns.behaviour_sets(patterns.matches(said, known), known, said.select("text_id", "owner")).withColumnRenamed("owner", "user_id")


QUERIES = {f.__name__: f for f in (watched_passages, behaviour_candidates, behaviour_sets)}

_REPORTS = "said AS (SELECT event_id, user_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REPORTS.items()) + " END || ' at ' || props AS text FROM events)"
# the patterns that reports can match, by hand
_KNOWN = r"""known(pattern, technique, tactic) AS (VALUES ('powershell\s+-[encw]', 'T1059.001', 'execution'), ('scheduled task|schtasks', 'T1053.005', 'persistence'), ('create mutex|openmutex', '', 'defense_evasion'),
    ('http post beacon|beacon interval', 'T1071', 'command_and_control'), ('virtual machine check|vmware|vbox|qemu detection', 'T1497.001', 'defense_evasion'), ('exfiltration over (alt protocol|c2)', 'T1048', 'exfiltration'))"""
_HITS = f"WITH {_REPORTS}, {_KNOWN}, hits AS (SELECT *, lower(regexp_extract(text, '(?i)' || pattern)) AS first FROM said JOIN known ON regexp_matches(text, '(?i)' || pattern)) "
ORACLES = {
    "watched_passages": r"""WITH w AS (SELECT item_id, string_split_regex(trim(text), '\s+')[2:5] AS w FROM benchmark WHERE len(string_split_regex(trim(text), '\s+')) >= 5),
        p AS (SELECT item_id, w[1] AS first, array_to_string(list_transform(w, lambda x: regexp_replace(x, '([^\p{L}\p{N}])', '\\\1', 'g')), '\s+') AS pattern FROM w)
        SELECT doc_id, item_id FROM documents JOIN p ON contains(lower(text), lower(first)) AND regexp_matches(text, '(?i)' || pattern)""",
    "behaviour_candidates": _HITS + "SELECT event_id, technique, tactic, first FROM hits",
    "behaviour_sets": _HITS + """SELECT user_id, tactic, count(DISTINCT event_id) AS n_texts, count(DISTINCT pattern) AS n_patterns, coalesce(string_agg(DISTINCT nullif(technique, ''), ',' ORDER BY nullif(technique, '')), '') AS techniques FROM hits GROUP BY 1, 2""",
}
