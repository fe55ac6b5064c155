"""Document independence: word shingles, exact Jaccard by an inverted join on rare shingles, MinHash, clusters of copies.

Equal normalised texts are one text first. The similarity join is exact: two sets with a Jaccard of t share one of their
n - ceil(t * n) + 1 rarest shingles, so only those are joined. Shingles of one text alone are the rarest and never meet,
so a text with fewer than ceil(t * n) others is left out, and of a pair the shingles from the one it meets in on must be
enough; every candidate is then counted over whole sets.

How many have a shingle is counted by 32 bits and a bucket's of its hash, for thousands of documents a row; shingles that
share these only make more candidates. Candidates are counted in blocks of documents that meet, so that a text's set is
moved once for each two blocks, not for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import mix, run_hashes
from ..functions.text import bound, normalised
from ..sources.shared import tabled as held
from .graph import components

#: Items that are packed together, and what a block of documents weighs (items, and 128 for each document).
BLOCK, WEIGHT = 1 << 20, 1 << 18


def shingles(text: Column, k: int = 8) -> Column:
    """The distinct runs of k words; a shorter text is one."""
    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(words[0] == "", F.array().cast("array<string>")).when(F.size(words) < k, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs))

    return bound(F.split(text, " "), of)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, body: the normalised text; rep_id: the smallest id with the same."""
    rows = held(docs.select("doc_id", normalised(F.col("text")).alias("body")).select("doc_id", F.unhex(F.sha2("body", 256)).alias("key"), "body"))
    return rows.join(rows.groupBy("key").agg(F.min("doc_id").alias("rep_id")), "key").drop("key")


def packed_items(sets: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """Items by bucket, for some thousand documents a row: docs, counts (items of each), codes (32 bits of each item's hash).

    Rows without codes have the documents' n (items), need (codes that a partner shares at least) and lost (items that
    share a code with another of the document's).
    """
    bits = np.uint64(buckets.bit_length() - 1)

    def rows(docs, sizes, items):
        import pyarrow as pa

        hashes = mix(items.view(np.uint64))
        # bucket, document, code: fewer than 2**20 documents and no more than 2**12 buckets
        key = (hashes >> (np.uint64(64) - bits)) << np.uint64(52) | np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32) | hashes >> (np.uint64(32) - bits) & np.uint64(0xFFFFFFFF)
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        bucket, own, low = (key >> np.uint64(52)).astype(np.int64), (key >> np.uint64(32) & np.uint64(0xFFFFF)).astype(np.int64), key.astype("<u4")
        lost = sizes - np.bincount(own, minlength=len(sizes))
        need = np.maximum(1, np.ceil(sizes * threshold - 1e-9).astype(np.int64) - lost)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[k], cuts[k + 1])
            some, counts = np.unique(own[at], return_counts=True)
            yield int(k), docs.take(pa.array(some)), counts, low[at].tobytes(), None, None, None
        yield int(bucket[len(bucket) // 2]), docs, np.zeros(len(sizes), np.int64), None, sizes, need, lost

    def of(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("items")), 0))
            flat, ends = batch.column("items").flatten().to_numpy(), np.cumsum(pc.list_value_length(batch.column("items")).to_numpy(), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                start = ends[at - 1] if at else 0
                stop = min(at + BLOCK // 4, max(at + 1, int(np.searchsorted(ends, start + BLOCK, "right"))))
                sizes = np.diff(np.append(start, ends[at:stop]))
                for bucket, ids, counts, codes, *known in rows(batch.column("doc_id").slice(at, stop - at), sizes, flat[start : ends[stop - 1]]):
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(counts, pa.int32()))]
                    more = [pa.array([None if x is None else x.tolist()], pa.list_(pa.int32())) for x in known]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *lists, pa.array([codes], pa.binary()), *more], ["bucket", "docs", "counts", "codes", "n", "need", "lost"])
                at = stop

    kind = sets.schema["doc_id"].dataType.simpleString()
    return sets.select("doc_id", "items").mapInArrow(of, f"bucket int, docs array<{kind}>, counts array<int>, codes binary, n array<int>, need array<int>, lost array<int>")


def live_items(packed: DataFrame) -> DataFrame:
    """doc_id, item (bucket and code), df of the items whose codes several documents have; and a row for each document with n, need and lost instead."""

    def of(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        docs = table.column("docs").combine_chunks().flatten()
        counts = np.concatenate([np.asarray(x, np.int64) for x in table.column("counts").to_pylist()])
        bucket = table.column("bucket")[0].as_py()
        codes = np.frombuffer(b"".join(x for x in table.column("codes").to_pylist() if x is not None), "<u4")
        own = np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(codes)
        codes, own = codes[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        df = np.repeat(times := np.diff(np.append(first, len(codes))), times)
        live = df > 1
        item = (bucket << 32) | codes[live].astype(np.int64)
        ends = np.cumsum([0, *pc.list_value_length(table.column("docs")).to_pylist()])
        about = [(at, row) for at, row in zip(ends, table.select(["n", "need", "lost"]).to_pylist(), strict=False) if row["n"] is not None]
        where = np.concatenate([own[live], *[at + np.arange(len(r["n"])) for at, r in about]]).astype(np.int64)
        none = len(where) - len(item)
        filled = lambda x: pa.array(np.append(x, np.zeros(none, np.int64)), pa.int64(), mask=np.arange(len(where)) >= len(item))
        known = lambda c: pa.array(np.concatenate([np.zeros(len(item), np.int64), *[r[c] for _, r in about]]), pa.int32(), mask=np.arange(len(where)) < len(item), safe=False)
        return pa.Table.from_arrays([docs.take(pa.array(where)), filled(item), filled(df[live]), known("n"), known("need"), known("lost")], ["doc_id", "item", "df", "n", "need", "lost"])

    kind = packed.schema["docs"].dataType.elementType.simpleString()
    return packed.groupBy("bucket").applyInArrow(of, f"doc_id {kind}, item long, df long, n int, need int, lost int")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """doc_id, n, after, item: the items of each document by which a partner finds it, and how many it has in common with one at most beside the item."""
    wanted = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live = live_items(packed_items(sets, threshold, min(4096, max(64, 1 << (wanted - 1).bit_length()))))
    # the row with n, need and lost comes first
    of, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("df", "item")
    ranked = live.select("doc_id", "item", "df", F.max("n").over(of).alias("n"), F.max("need").over(of).alias("need"), F.max("lost").over(of).alias("lost"), F.count("item").over(of).alias("n_live"), (F.row_number().over(order) - 1).alias("place"))
    return ranked.where("df > 1 AND place <= n_live - need + 1").select("doc_id", "n", (F.col("n_live") - F.col("place") + F.col("lost")).alias("after"), "item")


def homes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, block of the documents of pairs: documents are together with the first they meet; what is together makes blocks of about WEIGHT."""
    first = pairs.select(F.col("doc_b").alias("doc_id"), F.col("doc_a").alias("lead")).union(pairs.select("doc_a", "doc_a")).groupBy("doc_id").agg(F.min("lead").alias("lead"))
    rows = held(first.join(sizes, "doc_id").select("doc_id", "lead", (F.col("n") + 128).cast("long").alias("weight")))
    many = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.sum("weight")).first()[0] or 0) // WEIGHT)
    parts = rows.groupBy("lead").agg(F.ceil(F.sum("weight") / WEIGHT).alias("parts")).where("parts > 1")
    apart = F.xxhash64("lead", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    return rows.join(parts, "lead", "left").select("doc_id", F.coalesce(apart, F.pmod(F.xxhash64("lead"), F.lit(many))).alias("block"))


def counted(threshold: float):
    """Of a group's pairs and sets: the pairs with a Jaccard of threshold or more."""

    def of(pairs, sets):
        import pyarrow as pa
        import pyarrow.compute as pc

        names, items = sets.column("doc_id").combine_chunks(), sets.column("items").combine_chunks()
        sizes = np.array(pc.list_value_length(items), np.int64)
        starts = np.cumsum(sizes) - sizes
        different, codes = np.unique(items.flatten().to_numpy(), return_inverse=True)
        a, b = (np.array(pc.index_in(pairs.column(c), value_set=names), np.int64) for c in ("doc_a", "doc_b"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        flags, shared = np.zeros(len(different), bool), np.zeros(len(a), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
        for x, y in zip(cuts, cuts[1:], strict=False):
            own = codes[starts[a[x]] : starts[a[x]] + sizes[a[x]]]
            flags[own] = True
            lengths = sizes[b[x:y]]
            at = np.cumsum(lengths) - lengths
            spots = np.arange(at[-1] + lengths[-1]) + np.repeat(starts[b[x:y]] - at, lengths)
            shared[x:y] = np.add.reduceat(flags[codes[spots]], at, dtype=np.int64)
            flags[own] = False
        jaccard = shared / (sizes[a] + sizes[b] - shared)
        good = np.flatnonzero(jaccard >= threshold)
        return pa.Table.from_arrays([names.take(pa.array(a[good])), names.take(pa.array(b[good])), pa.array(jaccard[good])], ["doc_a", "doc_b", "jaccard"])

    return of


def similar_pairs(sets: DataFrame, threshold: float, some: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_a, doc_b, jaccard for sets (doc_id, items array<long>, each different) with a Jaccard of threshold or more.

    some: the sets of the documents given (doc_id), where that is less than to make all once more.
    """
    prefix = held(prefixes(sets, threshold))
    left, right = prefix.toDF("doc_a", "n_a", "after_a", "item"), prefix.toDF("doc_b", "n_b", "after_b", "item")
    # a pair's first common item leaves room for the others it needs
    enough = (F.least("after_a", "after_b") + 1) * F.lit(1 + threshold) >= (F.col("n_a") + F.col("n_b")) * F.lit(threshold) - F.lit(1e-6)
    pairs = held(left.join(right, "item").where((F.col("doc_a") < F.col("doc_b")) & enough).select("doc_a", "doc_b").distinct())
    blocks = held(homes(pairs, prefix.groupBy("doc_id").agg(F.max("n").alias("n"))))
    # a set goes to each two blocks once in which it has pairs, not to each pair
    one, other = blocks.toDF("doc_a", "one"), blocks.toDF("doc_b", "other")
    met = held(pairs.join(one, "doc_a").join(other, "doc_b").select(F.xxhash64(F.least("one", "other"), F.greatest("one", "other")).alias("meeting"), "doc_a", "doc_b"))
    ends = met.select(F.col("meeting").alias("at"), F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    chosen = (some or (lambda ids: sets.join(ids, "doc_id", "left_semi")))(blocks.select("doc_id"))
    there = ends.join(chosen.select("doc_id", "items"), "doc_id")
    kind = sets.schema["doc_id"].dataType.simpleString()
    return met.groupBy("meeting").cogroup(there.groupBy("at")).applyInArrow(counted(threshold), f"doc_a {kind}, doc_b {kind}, jaccard double")


def similar_texts(bodies: DataFrame, threshold: float, k: int = 8) -> DataFrame:
    """doc_a, doc_b, jaccard of different texts (doc_id, body, rep_id) by their runs of k words; only texts with candidates are read again."""
    return similar_pairs(shingle_sets(bodies, k), threshold, lambda ids: shingle_sets(bodies.join(ids, "doc_id", "left_semi"), k))


def shingle_codes(body: str, k: int) -> np.ndarray:
    """Different hashes of the runs of k words of a normalised text; a shorter text is one run, an empty one has none."""
    data = np.frombuffer(body.encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    blanks = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(data)]])
    k = min(k, len(starts))
    return np.unique(run_hashes(data, starts[: len(starts) - k + 1], ends[k - 1 :]))


def shingle_sets(bodies: DataFrame, k: int = 8) -> DataFrame:
    """doc_id, items: 64-bit hashes of the shingles of each different text."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            codes = [shingle_codes(body, k) for body in batch.column("body").to_pylist()]
            offsets = np.cumsum([0, *map(len, codes)], dtype=np.int32)
            items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*codes, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), items], ["doc_id", "items"])

    own = bodies.where("doc_id = rep_id").select("doc_id", "body")
    return own.mapInArrow(of, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, items array<long>")


def minhash(docs: DataFrame, k: int = 8, permutations: int = 64) -> DataFrame:
    """doc_id, signature: for each seed the smallest of the hashes of (seed, shingle), as byte-reversed hex of sha256's first 8 bytes."""
    def of(items: Column) -> Column:
        byte = lambda h, i: F.substring(h, 15 - 2 * i, 2)
        first = lambda h: F.concat(*[byte(h, i) for i in range(8)])
        least = lambda seed: F.array_min(F.transform(items, lambda x: bound(F.sha2(F.concat(seed.cast("string"), F.lit(":"), x).cast("binary"), 256), first)))
        zero = F.array_repeat(F.lit("0" * 16), permutations)
        return F.when(F.size(items) == 0, zero).otherwise(F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), least))

    return docs.select("doc_id", bound(shingles(normalised(F.col("text")), k), of).alias("signature"))


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / F.size(a)


def doc_clusters(docs: DataFrame, threshold: float = 0.85, k: int = 8) -> DataFrame:
    """doc_id, cluster_id, cluster_size: documents connected by pairs with a Jaccard of threshold or more."""
    bodies = held(texts(docs))
    pairs = similar_texts(bodies, threshold, k)
    reps = bodies.where("doc_id = rep_id").select(F.col("doc_id").alias("entity_id"))
    found = components(pairs.select(F.col("doc_a").alias("source"), F.col("doc_b").alias("target")), reps)
    named = bodies.select("doc_id", "rep_id").join(found, bodies["rep_id"] == found["entity_id"]).select("doc_id", F.col("component_id").alias("cluster_id"))
    sizes = named.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return named.join(sizes, "cluster_id").select("doc_id", "cluster_id", "cluster_size")


def story_clusters(items: DataFrame) -> DataFrame:
    """story_key, canonical_doc (earliest), n_copies, n_publishers of items (doc_id, story_key, publisher)."""
    return items.groupBy("story_key").agg(F.min("doc_id").alias("canonical_doc"), F.count(F.lit(1)).alias("n_copies"), F.greatest(F.lit(1).cast("long"), F.countDistinct("publisher")).alias("n_publishers"))
