"""The registered queries of this subpackage, each its operator over a whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, fingerprints, hard_negatives, html_extract, license_scan, mixing, near_dedup, packing, pieces, quality, token_store, warc
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_totals(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(table(spark, sf_dir, "documents")))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined_embeddings(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_source_mix, op3_quality, op4_warc, op5_fingerprints, op6_near_dedup, op7_license_scan, op8_token_files, op9_html_extract, op10_packing, op11_pieces, op12_hard_negatives, op13_alignment, pipeline)
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
            FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY body) AS kept, text_sha256
        FROM t""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.k, a.vec_id AS anchor_id, o.vec_id, o.label = a.label AS same,
                   coalesce(CAST(list_sum(list_transform(list_zip(a.vec, o.vec), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT), 0) AS score
            FROM v a JOIN v o ON o.vec_id <> a.vec_id
            WHERE a.vec_id % 50 = 0),
        p AS (
            SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS positive_rank
            FROM s WHERE same QUALIFY positive_rank <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(p.positive_rank AS INTEGER) AS positive_rank,
               CAST(row_number() OVER (PARTITION BY p.k, p.positive_rank ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS "rank",
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.k = p.k AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY "rank" <= 3""",
    "op4_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   (('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM p""",
}
