"""Queries of the targets that documents name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import targets
from ..sources.tables import read


def document_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.targets(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def shared_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.shared_targets(document_targets(spark, sf_dir), "doc_id")


QUERIES = {f.__name__: f for f in (document_targets, shared_targets)}


def _found(table: str, key: str) -> str:
    """Each kind by a pattern of its own, written out once more."""
    rest = r'''regexp_replace(regexp_replace(text, '(?i)https?://[^\s"''<>)\]]+', ' ', 'g'), '[\x{c0}-\x{1fff}\x{2c00}-\x{2dff}\x{3040}-\x{d7af}]', '_', 'g')'''
    kinds = [
        ("url", "text", r"""(?i)(https?://[^\s"''<>)\]]+)""", "v"), ("domain", "rest", r"(?i)\b((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,})\b", r"regexp_replace(lower(v), '\.+$', '')"),
        ("ip_address", "rest", r"(\b(?:\d{1,3}\.){3}\d{1,3}\b)", "v"), ("email", "rest", r"(\b[\w.+-]+@[\w-]+\.[\w.-]+\b)", "v"), ("asn", "rest", r"(?i)(\bAS\d{1,7}\b)", "upper(v)"),
        ("quoted", "text", "[\"''“”‘’]([^\"''“”‘’]{3,80})[\"''“”‘’]", r"regexp_replace(v, '^\s+|\s+$', '', 'g')"),
    ]
    each = " UNION ALL ".join(f"SELECT {key}, '{kind}' AS kind, {value} AS value, i FROM (SELECT {key}, unnest(regexp_extract_all({of}, '{p}', 1)) AS v, generate_subscripts(regexp_extract_all({of}, '{p}', 1), 1) AS i FROM t)" for kind, of, p, value in kinds)
    return f"WITH t AS (SELECT {key}, text, {rest} AS rest FROM {table} WHERE text <> ''), s AS ({each}), found AS (SELECT {key}, kind, arg_min(value, i) AS value, count(*) AS n FROM s GROUP BY {key}, kind, lower(value)) "


ORACLES = {
    "document_targets": _found("documents", "doc_id") + "SELECT * FROM found",
    "shared_targets": _found("documents", "doc_id") + "SELECT kind, lower(value) AS value, count(DISTINCT doc_id) AS n_texts FROM found GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1",
}
