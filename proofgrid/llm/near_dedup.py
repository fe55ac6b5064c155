"""Near-duplicate documents by order MinHash of five-word k-mers, verified by banded alignment.

A text's k-mers are labelled with their occurrence (first, second, ... of the same words). Each of SKETCHES hash functions
samples the SAMPLED smallest labelled k-mers and keeps them in text order; texts with an equal sketch are candidates, so
what is found follows edit similarity, not the bare set of k-mers. FINE_SKETCHES more sample pairs of words (FINE_K) in the
same way, for texts with edits so dense that few k-mers survive; of these sketches two have to be shared with a leader. Candidates count as near when their word sequences
align with at most (1 - THRESHOLD) * the longer length edits (insert, delete, replace), found by alignment in a band of
that width. Classes are the connected components of the verified links.

Exact copies (equal words) meet first by digest and byte comparison and are one text from then on. A bucket of equal
sketches whose texts differ in length beyond the threshold is split into overlapping bands of length. A bucket's smallest text
is its leader; the texts that meet a leader are its star. In a star all pairs are judged: how many words each two share, repeats
counted, is a product of matrices, which rules out most; what is left is aligned unless both are known to be connected. Nothing
is sampled or capped there, so a near pair is missed only if its texts share no sketch. Whole texts come to a star by one
shuffle. Stars of more than STAR texts, or STAR_WORDS words, are dealt over blocks, and each two blocks meet in a group of
their own, with the leader: no task holds more than two blocks at a time, and the work of a star of unrelated texts with a common
passage, where every pair has to be looked at, is spread over all tasks, though it grows with the square of that star. Leaders
are found by partial aggregation; large buckets, a bounded number, come to their members by broadcast, so no bucket is
gathered in one task.

Different texts are told apart by a number of their own, so that nothing rests on document ids. Nulls, ties and odd input:
a null text is empty; texts without words are one class of copies; a text of fewer than five words is one k-mer; the
smallest id of a class names it, null if all its ids are null; of equal ids, or none, that with the smallest digest of its
text stays; rows that repeat an id and its text are one document, rows that repeat an id alone are not; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, chunks, mix, shingle_hashes, stored, text_or_empty, word_hashes

K, SKETCHES, SAMPLED, THRESHOLD = 5, 24, 2, 0.8
FINE_K, FINE_SKETCHES = 2, 32
#: A bucket is large if it has more rows than LARGE and more than one of MOST_LARGE parts of all: so MOST_LARGE of them are
#: broadcast at most, and no other has rows enough to hold up a task.
LARGE, MOST_LARGE = 1000, 20_000
#: A block of a star has so many texts and words on average.
STAR, STAR_WORDS = 512, 1 << 20
#: Words of so many texts of a group or fewer are counted pair by pair, others by products of matrices, so many words at once.
FEW, WIDTH = 8, 4096
_LARGEST = np.uint64((1 << 64) - 1)


def occurrence_labelled(kmers: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with the number of equal ones before each."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(kmers))
    nth = np.empty(len(kmers), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(kmers + nth * np.uint64(0xD6E8FEB86659FD93))


def order_minhash(words: np.ndarray, k: int = K, sketches: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray | None:
    """One hash a sketch of the sampled k-mers in text order; None for a text without words."""
    if not len(words):
        return None
    labelled = occurrence_labelled(shingle_hashes(words, k))
    sampled = min(sampled, len(labelled))
    places = np.empty((sketches, sampled), np.int64)
    factors = mix(np.arange(1, sketches + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)
    for j in range(sketches):
        # labelled k-mers are mixed already, so a random odd factor alone gives another order
        own = labelled * factors[j]
        for t in range(sampled):
            places[j, t] = at = own.argmin()
            own[at] = _LARGEST
    places.sort(axis=1)
    out = np.arange(1, sketches + 1, dtype=np.uint64)
    for t in range(sampled):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + labelled[places[:, t]])
    return out


def shared_words(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The size of the multiset intersection of two texts' words, each as different ones in order and their counts."""
    (x, n), (y, m) = a, b
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int(np.minimum(n[at], m)[x[at] == y].sum())


def differing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two texts without their equal beginnings and, of what is left, ends."""
    for step in (1, -1):
        k = min(len(a), len(b))
        same = a[::step][:k] == b[::step][:k]
        same = k if same.all() else int(same.argmin())
        a, b = (a[same:], b[same:]) if step > 0 else (a[: len(a) - same], b[: len(b) - same])
    return a, b


def banded_edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The least number of word edits that turn a into b if it is at most `most`, else None.

    Equal ends cost nothing and are left out. Only the band of cells within `most` of the diagonal is followed, a column of it as bits of one integer: where the
    cell below is one more (up) or one less (down). The last cell's value is summed along the band's lower edge, then
    along the last row (bit-parallel edit distance, Hyyrö 2003).
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    a, b = differing(a, b)
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return max(n, m)
    most = min(most, max(n, m))
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    # what isn't in the longest common subsequence is edited: its length, by Hyyrö's bits (2004), rules most pairs out in a fraction of the time
    every, find, others = (1 << n) - 1, where.get, b.tolist()
    free = every
    for w in others:
        if same := find(w):
            taken = free & same
            free = (free + taken | free - taken) & every
    if max(n, m) - (n - free.bit_count()) > most:
        return None
    full, edge = (1 << 2 * most + 1) - 1, 1 << 2 * most
    up, down, edits = full ^ ((1 << most) - 1), 0, min(most, n)
    for j, w in enumerate(others, 1):
        same = find(w, 0)
        if same:
            shift = j - most - 1
            same = (same >> shift if shift >= 0 else same << -shift) & full
        equal = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = down | full ^ (equal | up), equal & up
        if j + most <= n:
            if not equal & edge:
                edits += 1
                if edits > 2 * most + m - n:
                    return None
        else:
            row = n - j + most
            edits += (right_up >> row & 1) - (right_down >> row & 1)
            if edits - (m - j) > most:
                return None
        equal >>= 1
        up, down = right_down | full ^ (equal | right_up), equal & right_up
    return edits if edits <= most else None


def near(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the word sequences have an edit similarity (1 - edits / longer length) of at least threshold."""
    longer = max(len(a), len(b))
    most = int((1 - threshold) * longer + 1e-9)
    if min(len(a), len(b)) < longer - most:
        return False
    if longer and longer - shared_words(np.unique(a, return_counts=True), np.unique(b, return_counts=True)) > most:
        return False
    return banded_edits(a, b, most) is not None


def with_bucket(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows beside their bucket's row of found (key, n, ...): large buckets come to the rows, rows are shuffled to the others."""
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = F.col("n") > max(LARGE, total // MOST_LARGE)
    few, many = found.where(large).drop("n"), found.where(~large).drop("n")
    rest = rows.join(F.broadcast(few.select("key")), "key", "left_anti")
    return rows.join(F.broadcast(few), "key").unionByName(rest.join(many, "key"))


def in_bands(keys: DataFrame, threshold: float) -> DataFrame:
    """key, id, n_words, weight: the members of buckets of two texts or more; buckets of unlike lengths as bands, two for each text, of which near texts share one."""
    found = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.max("n_words") * F.lit(threshold - 1e-9) > F.min("n_words")).alias("unlike")).where("n > 1")
    members = with_bucket(keys, stored(found, "buckets"))
    band = F.floor(F.ln("n_words") / F.lit(-np.log(threshold) * (1 + 1e-9)))
    split = members.where("unlike").select(F.explode(F.array(band, band + 1)).alias("band"), "key", "id", "n_words", "weight").select(F.xxhash64("key", "band").alias("key"), "id", "n_words", "weight")
    return members.where("NOT unlike").select("key", "id", "n_words", "weight").unionByName(split)


def with_leader(keys: DataFrame, least: int) -> DataFrame:
    """leader, id, n_words (of id): different pairs of the members of buckets (key, id, n_words, weight) of two texts or more and the smallest of them, if the buckets they meet in weigh `least` together."""
    found = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = with_bucket(keys, stored(found, "buckets")).where("id <> leader").groupBy("leader", "id").agg(F.sum("weight").alias("weight"), F.max("n_words").alias("n_words"))
    return met.where(F.col("weight") >= least).select("leader", "id", "n_words")


def overlaps(texts: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words, repeats counted, each text of left shares with each other text of right (places in texts)."""
    out = np.zeros((len(left), len(right)), np.int64)
    labelled = [occurrence_labelled(w) if len(w) else w for w in texts]
    of = np.repeat(np.arange(len(texts)), [len(w) for w in labelled])
    _, token, n = np.unique(np.concatenate(labelled), return_inverse=True, return_counts=True)
    of = of[np.argsort(token, kind="stable")]
    start = np.cumsum(n) - n
    of_left, of_right = np.full(len(texts), -1), np.full(len(texts), -1)
    of_left[left], of_right[right] = np.arange(len(left)), np.arange(len(right))
    for few in range(2, FEW + 1):
        have = start[n == few]
        for at in range(0, len(have), WIDTH):
            rows = of[have[at : at + WIDTH, None] + np.arange(few)]
            i, j = of_left[rows][:, :, None], of_right[rows][:, None, :]
            np.add.at(out.reshape(-1), (i * len(right) + j)[(i >= 0) & (j >= 0)], 1)
    many = np.flatnonzero(n > FEW)
    for at in range(0, len(many), WIDTH):
        here = many[at : at + WIDTH]
        has = np.zeros((len(texts), len(here)), np.float32)
        places = np.arange(n[here].sum()) + np.repeat(start[here] - (np.cumsum(n[here]) - n[here]), n[here])
        has[of[places], np.repeat(np.arange(len(here)), n[here])] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def star_links(texts: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between near texts of left and right (places in texts, the leader's first in both), as many as connect what these links connect."""
    n = np.array([len(w) for w in texts])
    longer = np.maximum.outer(n[left], n[right])
    most = ((1 - threshold) * longer + 1e-9).astype(np.int64)
    may = overlaps(texts, left, right) >= longer - most
    parent, links = list(range(len(texts))), []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    def meet(a: int, b: int, edits: int) -> None:
        x, y = root(a), root(b)
        if x != y and banded_edits(texts[a], texts[b], edits) is not None:
            parent[y] = x
            links.append((a, b))

    for j in np.flatnonzero(may[0]).tolist():
        meet(int(left[0]), int(right[j]), int(most[0, j]))
    for i in np.flatnonzero(may[:, 0]).tolist():
        meet(int(right[0]), int(left[i]), int(most[i, 0]))
    part = np.array([root(a) for a in range(len(texts))])
    for i in range(1, len(left)):
        for j in np.flatnonzero(may[i] & (right > left[i]) & (part[right] != part[left[i]])).tolist():
            meet(int(left[i]), int(right[j]), int(most[i, j]))
    return links


def dealt(pairs: DataFrame) -> DataFrame:
    """leader, one, other, id, block for each member of a star, its leader too: groups of one block or two, in which each two members of a star meet in one at least, and the leader all."""
    stars = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    blocks = F.ceil(F.greatest(F.col("n") / STAR, F.col("words") / STAR_WORDS)).cast("int")
    large = F.broadcast(stars.select("leader", blocks.alias("blocks")).where("blocks > 1"))
    rows = pairs.select("leader", "id").union(pairs.select("leader", F.col("leader").alias("id")).distinct())
    rows = rows.join(large, "leader", "left").select("leader", "id", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    return rows.withColumn("block", F.expr("CAST(IF(id = leader, -1, pmod(xxhash64(id), blocks)) AS int)"))


def in_stars(pairs: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect the near texts of each star. pairs: leader, id, n_words; contents: id, content."""
    everywhere = "flatten(transform(sequence(0, blocks - 1), i -> transform(sequence(i, blocks - 1), j -> struct(i AS one, j AS other))))"
    own = "transform(sequence(0, blocks - 1), j -> struct(least(block, j) AS one, greatest(block, j) AS other))"
    whole = dealt(pairs).join(contents.select("id", F.col("content").alias("text")), "id")
    groups = whole.select("leader", "id", "block", "text", F.explode(F.expr(f"IF(block < 0, {everywhere}, {own})")).alias("group"))
    # few bytes may be much work, so partitions aren't coalesced
    many = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.select("leader", "group.one", "group.other", "block", "id", "text").repartition(many, "leader", "one", "other").sortWithinPartitions("leader", "one", "other", "block", "id")

    def judge(batches):
        import pyarrow as pa

        def links(group: tuple, ids: list[int], blocks: list[int], texts: list[np.ndarray]):
            _, one, other = group
            block, at = np.array(blocks), np.arange(len(ids))
            if one == other:
                left = right = at
            else:
                left, right = at[(block < 0) | (block == one)], at[(block < 0) | (block == other)]
            found = star_links(texts, left, right, threshold)
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], ["a", "b"])

        last, ids, blocks, texts = None, [], [], []
        for some in chunks(batches):
            for r in some:
                group = (r["leader"], r["one"], r["other"])
                if group != last:
                    if last:
                        yield links(last, ids, blocks, texts)
                    last, ids, blocks, texts = group, [], [], []
                ids.append(r["id"])
                blocks.append(r["block"])
                texts.append(word_hashes(r["text"]))
        if last:
            yield links(last, ids, blocks, texts)

    return groups.mapInArrow(judge, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, class_id for every id in edges (a, b): the smallest id it is connected with.

    Each round, every id points to its smallest neighbour if that is smaller, edges move to the ids pointed to, and loops
    go; at least half of the ids that have edges lose them in a round. Every round's tables are stored.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    found = None
    while True:
        both = edges.union(edges.select("b", "a"))
        points = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to")), "points")
        if found is None:
            found = points.select("id", F.col("to").alias("class_id"))
        else:
            moved = points.select(F.col("id").alias("class_id"), "to")
            found = stored(found.join(moved, "class_id", "left").select("id", F.coalesce("to", "class_id").alias("class_id")), "classes")
        first = edges.join(points.withColumnsRenamed({"id": "a", "to": "new_a"}), "a")
        second = first.join(points.withColumnsRenamed({"id": "b", "to": "new_b"}), "b")
        edges = stored(second.select(F.greatest("new_a", "new_b").alias("a"), F.least("new_a", "new_b").alias("b")).where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return found


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text_md5 of the raw text, content (its words, one space between) and two digests of that."""
    words = F.trim(F.regexp_replace(text_or_empty(), WHITE, " "))
    rows = docs.select("doc_id", F.md5(text_or_empty()).alias("text_md5"), words.alias("content"))
    return rows.select("*", F.md5("content").alias("hash128"), F.sha2("content", 256).alias("sha256"))


def different_texts(rows: DataFrame) -> DataFrame:
    """id, hash128, sha256, content and first (the row that would stay: no_id, doc_id, text_md5) of each different content, stored.

    Grouping by digest and content compares bytes inside each digest's group; equal rows meet on the map side first.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5")).alias("first")
    groups = rows.groupBy("hash128", "content").agg(F.first("sha256").alias("sha256"), first)
    return stored(groups.select(F.monotonically_increasing_id().alias("id"), "hash128", "sha256", "content", "first"), "near-texts", "zstd")


def sketched(texts: DataFrame) -> DataFrame:
    """id, number of words and sketch of each different text (id, content)."""

    def sketch(batches):
        import pyarrow as pa

        for some in chunks(batches):
            words = [word_hashes(r["content"]) for r in some]
            marks = [None if not len(w) else np.concatenate([order_minhash(w), order_minhash(w, FINE_K, FINE_SKETCHES)]) for w in words]
            columns = [
                pa.array([r["id"] for r in some], pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([None if m is None else m.view(np.int64) for m in marks], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "sketch"])

    return texts.select("id", "content").mapInArrow(sketch, "id long, n_words long, sketch array<long>")


def near_links(sketches: DataFrame, contents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that connect the near texts (id, content) of each star."""
    # unrelated texts meet in one fine sketch now and then; near ones share several, or one of five-word k-mers
    keys = sketches.where("sketch IS NOT NULL").select("id", "n_words", F.posexplode("sketch").alias("at", "key")).select("key", "id", "n_words", F.when(F.col("at") < SKETCHES, 2).otherwise(1).alias("weight"))
    members = stored(in_bands(keys, threshold), "bands")
    return stored(in_stars(stored(with_leader(members, 2), "pairs"), contents, threshold), "links")


def classified(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, text_md5, class_id and kept for every row of docs."""
    rows = digested(docs)
    texts = different_texts(rows)
    sketches = stored(sketched(texts), "sketches")
    classes = components(near_links(sketches, texts, threshold))
    members = texts.select("id", "hash128", "sha256", "first").join(classes, "id", "left").withColumn("class", F.coalesce("class_id", "id")).drop("class_id")
    best = members.groupBy("class").agg(F.min("first").alias("best"))
    named = stored(members.join(best, "class").select("hash128", "sha256", "best"), "classes")
    kept = F.expr("doc_id <=> best.doc_id AND text_md5 = best.text_md5")
    return rows.drop("content").join(named, ["hash128", "sha256"]).select("doc_id", "text_md5", F.col("best.doc_id").alias("class_id"), kept.alias("kept"))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), kept for every row of docs."""
    return classified(docs, threshold).drop("text_md5")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, with its columns."""
    kept = classified(docs, threshold).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_md5").alias("__kept_md5")).distinct()
    mine = docs.withColumn("__own_md5", F.md5(text_or_empty()))
    joined = mine.join(kept, F.expr("doc_id <=> __kept_id AND __own_md5 = __kept_md5"), "left_semi")
    return joined.dropDuplicates(["doc_id", "__own_md5"]).select(*[docs[c] for c in docs.columns])
