"""Exact dedup with DataFrame functions only: 128-bit content hash, smallest id stays, bytes compared inside groups.

Nulls, ties and odd input: a null text counts as empty. Null ids are ignored when the smallest id is taken; a group in
which every id is null has a null keep_id, and its rows are kept. doc_id identifies a document, so rows that repeat an id
and its text all get that document's answer. Other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, text_or_empty


def one_space(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, WHITE, " ")


def hashed(docs: DataFrame, content: Column) -> DataFrame:
    """doc_id, content and its 128-bit and 256-bit digests."""
    return docs.select("doc_id", content.alias("content")).select(
        "doc_id", "content", F.md5("content").alias("hash128"), F.sha2("content", 256).alias("text_sha256")
    )


def content_groups(rows: DataFrame) -> DataFrame:
    """One row for each different content: hash128, text_sha256, content, keep_id, group_size.

    Grouping by the hash and the content compares bytes inside each hash group, so a collision makes two groups. Equal
    rows meet on the map side first, so a group that holds a third of all rows costs one row a task in the shuffle.
    """
    return rows.groupBy("hash128", "content").agg(
        F.first("text_sha256").alias("text_sha256"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def exact_dedup(docs: DataFrame, content: Column | None = None, hash_column: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    content: what is compared (default: text with white-space runs as one space). hash_column: another group hash over
    `content`, for tests of collisions. Rows find their group by both digests; the second tells apart contents that
    share the first.
    """
    rows = hashed(docs, one_space(text_or_empty()) if content is None else content)
    if hash_column is not None:
        rows = rows.withColumn("hash128", hash_column)
    groups = content_groups(rows).select("hash128", "text_sha256", "keep_id", "group_size")
    return (
        rows.drop("content")
        .join(groups, ["hash128", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, each document once, with all their columns."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256").distinct()
    mine = docs.withColumn("__own_sha256", F.sha2(one_space(text_or_empty()), 256))
    joined = mine.join(
        kept, mine["doc_id"].eqNullSafe(kept["kept_id"]) & (mine["__own_sha256"] == kept["text_sha256"]), "left_semi"
    )
    return joined.dropDuplicates(["doc_id", "__own_sha256"]).select(*[docs[c] for c in docs.columns])
