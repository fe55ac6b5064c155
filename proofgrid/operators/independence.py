"""Which evidence counts as one source: dependence between documents, and first-come representatives.

Documents of a group (what backs one claim, say) come in order. Each joins the first representative it depends on, or else
becomes one: not components, as a document that resembles a member but not its representative starts a cluster of its own.
Representatives are found in rounds: whoever comes before all undecided documents it depends on is one, and what depends on
it is decided. Rules are keys that documents share (a hash, an upstream, a publisher, a similar pair), so that a key with
many documents costs a row for each and no pairs; a round is an aggregate by key and a join back. Rounds are as many as the
longest chain of documents that wait for each other.

Nulls, ties and odd input: a null or empty hash, upstream or publisher makes nothing depend; a null group is a group; equal
turns go by doc_id; repeated rows (group, doc_id) are one document; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import tabled as held

# The rules in order, each with what it says.
RULES = {
    1: ("DEPENDENT", "identical content hash"), 2: ("DEPENDENT", "declared syndication/upstream relationship"), 3: ("DEPENDENT", "common declared upstream dataset"),
    4: ("DEPENDENT", "near-duplicate content"), 5: ("PARTIALLY_DEPENDENT", "heavy overlap"), 6: ("PARTIALLY_DEPENDENT", "same publisher domain"),
}
NEAR, PARTIAL = 0.85, 0.55


def named(rule: Column) -> tuple[Column, Column]:
    """The kind of dependence and the reason of a rule's number."""
    return tuple(F.element_at(F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[at])]), rule) for at in (0, 1))


def rule_keys(docs: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """grp, doc_id, key, side, rule: what each document shares. Of side 0 it depends on all with the key, of side 1 or 2 on those of the other side.

    docs: grp, doc_id, turn, sha256, source, publisher, upstream; similar: doc_a, doc_b, jaccard, of any groups.
    """
    def keys(column: str, side: int, rule: int) -> DataFrame:
        value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
        return docs.select("grp", "doc_id", F.concat(F.lit(f"{rule}:"), value).alias("key"), F.lit(side).alias("side"), F.lit(rule).alias("rule")).where("key IS NOT NULL")

    found = keys("sha256", 0, 1).union(keys("upstream", 1, 2)).union(keys("source", 2, 2)).union(keys("upstream", 0, 3)).union(keys("publisher", 0, 6))
    if similar is None:
        return found
    close = similar.where(F.col("jaccard") >= PARTIAL).select("doc_a", "doc_b", F.concat_ws(":", F.lit("pair"), "doc_a", "doc_b").alias("key"), F.when(F.col("jaccard") >= NEAR, 4).otherwise(5).alias("rule"))
    ends = close.select(F.col("doc_a").alias("doc_id"), "key", "rule").union(close.select("doc_b", "key", "rule"))
    return found.union(docs.select("grp", "doc_id").join(ends, "doc_id").select("grp", "doc_id", "key", F.lit(0), "rule"))


def with_first(rows: DataFrame, among: DataFrame) -> DataFrame:
    """rows (grp, key, side, ...) with first: the least `who` of among (grp, key, side, who) that a row of its side depends on."""
    of = lambda side: F.min(F.when(F.col("side") == side, F.col("who"))).alias(f"s{side}")
    firsts = among.groupBy("grp", "key").agg(of(0), of(1), of(2)).withColumnsRenamed({"grp": "g", "key": "k"})
    return rows.join(firsts, F.expr("grp <=> g AND key = k")).withColumn("first", F.expr("CASE side WHEN 0 THEN s0 WHEN 1 THEN s2 ELSE s1 END")).drop("g", "k", "s0", "s1", "s2")


def representatives(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """grp, doc_id, who (turn, doc_id) of every representative, in rounds of three stored tables each. docs: grp, doc_id, who; rows: their keys, with who.

    A round reads only the documents and keys that are undecided.
    """
    undecided, live = docs, rows
    own = lambda left, right: F.expr(f"{left}.grp <=> {right}.grp AND {left}.doc_id = {right}.doc_id")
    found = None
    while True:
        waits = with_first(live, live).where("first < who").select("grp", "doc_id").distinct()
        new = held(undecided.alias("u").join(waits.alias("w"), own("u", "w"), "left_anti"))
        found = new if found is None else found.union(new)
        # those that depend on a new representative are decided
        heads = live.alias("k").join(new.alias("n"), own("k", "n"), "left_semi")
        covered = with_first(live, heads).where("first < who").select("grp", "doc_id").distinct()
        gone = covered.union(new.select("grp", "doc_id"))
        undecided = held(undecided.alias("u").join(gone.alias("g"), own("u", "g"), "left_anti"))
        if undecided.isEmpty():
            return found
        live = held(live.alias("k").join(undecided.alias("u"), own("k", "u"), "left_semi"))


def independent_clusters(docs: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """grp, doc_id, representative, kind, reason: the first representative that each document depends on, and by which rule; representatives are their own."""
    every = held(docs.groupBy("grp", "doc_id").agg(F.min("turn").alias("turn")).select("grp", "doc_id", F.struct("turn", "doc_id").alias("who")))
    own = lambda left, right: F.expr(f"{left}.grp <=> {right}.grp AND {left}.doc_id = {right}.doc_id")
    rows = held(rule_keys(docs, similar).distinct().alias("k").join(every.alias("u"), own("k", "u")).select("k.*", "u.who"))
    firsts = representatives(every, rows)
    heads = rows.alias("k").join(firsts.alias("n"), own("k", "n"), "left_semi")
    best = with_first(rows, heads).where("first < who").groupBy("grp", "doc_id").agg(F.min(F.struct("first", "rule")).alias("best"))
    joined = every.alias("e").join(best.alias("b"), own("e", "b"), "left").join(firsts.select("grp", "doc_id", F.lit(True).alias("is_first")).alias("f"), own("e", "f"), "left")
    kind, reason = named(F.expr("IF(is_first, NULL, b.best.rule)"))
    return joined.select("e.grp", "e.doc_id", F.expr("IF(is_first, e.doc_id, b.best.first.doc_id)").alias("representative"), kind.alias("kind"), reason.alias("reason"))


def independent_evidence(docs: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """grp, n_docs, n_sources: how many documents and how many independent sources each group has."""
    found = independent_clusters(docs, similar)
    return found.groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("representative").alias("n_sources"))
