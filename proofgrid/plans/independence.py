"""Queries of source independence: clusters by first-come representatives, and the gate of facts fed by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, independence, trust
from ..sources.adapters import TWINS, observations
from ..sources.shared import tabled
from ..sources.tables import read
from .texts import _SETS
from .trust_plane import _GATE, NOW


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence behind each claim (predicate and value): a user is a publisher, and every ninth event names the next source as its upstream."""
    rows = observations(spark, sf_dir).where("evidence_id IS NOT NULL")
    upstream = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("s"), ((F.col("source_id") + 1) % 7).cast("string"), F.lit(":"), F.date_format("observed_at", "yyyy-MM-dd")))
    return rows.select(
        F.concat_ws("|", "predicate", "value").alias("grp"), F.col("evidence_id").alias("doc_id"), F.col("observed_at").alias("turn"), F.lit(None).cast("string").alias("sha256"),
        F.concat(F.lit("s"), F.col("source_id").cast("string"), F.lit(":"), F.date_format("observed_at", "yyyy-MM-dd")).alias("source"), F.split("subject_id", ":")[0].alias("publisher"), upstream.alias("upstream"),
    )


def claim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evidence of a claim counts as one source, and why."""
    return independence.independent_clusters(evidence(spark, sf_dir))


def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many independent sources a claim has."""
    return independence.independent_evidence(evidence(spark, sf_dir))


def independent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of facts, corroboration counted by independent sources."""
    clusters = independence.independent_clusters(evidence(spark, sf_dir)).select(F.col("doc_id").alias("evidence_id"), F.col("representative").alias("cluster_id"))
    return trust.fact_gate(observations(spark, sf_dir), NOW, clusters)


def document_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in order of id: copies by hash, near copies and heavy overlap by eight-word shingles."""
    docs = read(spark, sf_dir, "documents")
    bodies = tabled(documents.texts(docs))
    similar = tabled(documents.similar_texts(bodies, independence.PARTIAL))
    # equal normalised texts are one text, for which its first document stands: they share its pairs
    none = F.lit(None).cast("string")
    firsts = bodies.where("doc_id = rep_id AND body <> ''").select(F.lit("all").alias("grp"), "doc_id", F.col("doc_id").alias("turn"), none.alias("sha256"), none.alias("source"), none.alias("publisher"), none.alias("upstream"))
    found = independence.independent_clusters(firsts, similar)
    same = bodies.where("body <> ''").join(found.withColumnRenamed("doc_id", "rep_id"), "rep_id")
    copy = (F.col("doc_id") != F.col("rep_id")) & (F.col("representative") == F.col("rep_id"))
    kind, reason = independence.named(F.lit(4))
    named = same.select("doc_id", "representative", F.when(copy, kind).otherwise(F.col("kind")).alias("kind"), F.when(copy, reason).otherwise(F.col("reason")).alias("reason"))
    empty = bodies.where("body = ''").select("doc_id", F.col("doc_id").alias("representative"), none.alias("kind"), none.alias("reason"))
    return named.unionByName(empty)


QUERIES = {f.__name__: f for f in (claim_clusters, claim_sources, independent_gate, document_representatives)}

#: Documents one after the other: a state for each group holds the representatives so far.
_CLUSTERS = f"""{TWINS["observations"].replace("WITH obs", "WITH RECURSIVE obs")}, d AS (
        SELECT predicate || '|' || value AS grp, evidence_id AS doc_id, 's' || source_id || ':' || strftime(observed_at, '%Y-%m-%d') AS source, split_part(subject, ':', 1) AS publisher,
               CASE WHEN event_id % 9 = 0 THEN 's' || ((source_id + 1) % 7) || ':' || strftime(observed_at, '%Y-%m-%d') END AS upstream,
               row_number() OVER (PARTITION BY predicate || '|' || value ORDER BY observed_at, evidence_id) AS k
        FROM obs WHERE evidence_id IS NOT NULL),
      step AS (
        SELECT grp, 0::BIGINT AS k, []::STRUCT(id BIGINT, source VARCHAR, publisher VARCHAR, upstream VARCHAR)[] AS reps, NULL::BIGINT AS doc_id, NULL::BIGINT AS representative, NULL::INTEGER AS rule FROM d GROUP BY grp
        UNION ALL
        SELECT grp, k, CASE WHEN hit IS NULL THEN list_append(reps, {{'id': doc_id, 'source': source, 'publisher': publisher, 'upstream': upstream}}) ELSE reps END, doc_id, coalesce(hit.id, doc_id),
               CASE WHEN hit IS NULL THEN NULL WHEN upstream = hit.source OR hit.upstream = source THEN 2 WHEN upstream = hit.upstream THEN 3 ELSE 6 END
        FROM (SELECT d.*, s.reps, list_filter(s.reps, lambda r: coalesce(d.upstream = r.source, false) OR coalesce(r.upstream = d.source, false) OR coalesce(d.upstream = r.upstream, false) OR d.publisher = r.publisher)[1] AS hit
              FROM step s JOIN d ON d.grp = s.grp AND d.k = s.k + 1)),
      found AS (SELECT grp, doc_id, representative,
               CASE WHEN rule IS NOT NULL THEN CASE WHEN rule = 6 THEN 'PARTIALLY_DEPENDENT' ELSE 'DEPENDENT' END END AS kind,
               CASE rule WHEN 2 THEN 'declared syndication/upstream relationship' WHEN 3 THEN 'common declared upstream dataset' WHEN 6 THEN 'same publisher domain' END AS reason
               FROM step WHERE k > 0) """
_FED = _GATE.removeprefix(TWINS["observations"]).replace("AS needs FROM obs)", "AS needs, coalesce(representative, evidence_id) AS source_doc FROM obs LEFT JOIN found ON doc_id = evidence_id)").replace("count(DISTINCT evidence_id)", "count(DISTINCT source_doc)")
ORACLES = {
    "independent_gate": f"{_CLUSTERS} {_FED} SELECT * FROM gate",
    "claim_clusters": f"{_CLUSTERS} SELECT * FROM found",
    "claim_sources": f"{_CLUSTERS} SELECT grp, count(*) AS n_docs, count(DISTINCT representative) AS n_sources FROM found GROUP BY grp",
    "document_representatives": f"""{_SETS}, near AS (SELECT doc_a, doc_b, jaccard FROM pairs WHERE jaccard >= 0.55),
        firsts AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM reps),
        edges AS (SELECT doc_b AS doc_id, list({{'id': doc_a, 'j': jaccard}} ORDER BY doc_a) AS before FROM near GROUP BY doc_b),
        ordered AS (SELECT firsts.*, coalesce(before, []) AS before FROM firsts LEFT JOIN edges USING (doc_id)),
        step AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS heads, NULL::BIGINT AS doc_id, NULL::BIGINT AS representative, NULL::DOUBLE AS j
            UNION ALL
            SELECT k, CASE WHEN hit IS NULL THEN list_append(heads, doc_id) ELSE heads END, doc_id, coalesce(hit.id, doc_id), hit.j
            FROM (SELECT o.*, s.heads, list_filter(o.before, lambda e: list_contains(s.heads, e.id))[1] AS hit FROM step s JOIN ordered o ON o.k = s.k + 1)),
        found AS (SELECT n.doc_id, r.doc_id AS own, representative, j FROM n JOIN reps r USING (body) JOIN step s ON s.doc_id = r.doc_id)
        SELECT doc_id, representative,
               CASE WHEN doc_id = representative THEN NULL WHEN own = representative OR j >= 0.85 THEN 'DEPENDENT' ELSE 'PARTIALLY_DEPENDENT' END AS kind,
               CASE WHEN doc_id = representative THEN NULL WHEN own = representative OR j >= 0.85 THEN 'near-duplicate content' ELSE 'heavy overlap' END AS reason
        FROM found UNION ALL SELECT doc_id, doc_id, NULL, NULL FROM n WHERE body = ''""",
}
