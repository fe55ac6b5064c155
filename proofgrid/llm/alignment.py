"""Alignment of two tokenizers over a corpus: groups of tokens that end together, links of tokens that overlap, how often ids are linked.

Texts are shuffled whole, so that each different one is tokenised and aligned once and its pair counts weigh as many times
as it has copies; its measures come back to the documents by digest. A byte-level vocabulary (A) reads a space and the
text, a piece vocabulary (B) the text, to which it adds that space itself. Neither has tokens across the starts of
stretches (see pieces), so a stretch's tokens, groups and links are found once in a while and looked up in between.

Texts are gathered in blocks of about BLOCK words. A block lists its different stretches with their links, and each text as
numbers of stretches; so Spark adds up one row for each id pair of a block instead of one for each link, and brings the
sums back to the block in the same way. Sums, and the highest for each B id, are plain aggregates and joins. Nothing is
gathered but a block, whose size is bounded, save for a single text beyond it.

Nulls, ties and odd input: a null or empty text, and one whose joined token bytes of A or B differ from its own (U+2581 in
it, which B reads as a space), has no tokens: its measures are 0 and its digest empty, and it adds to no count. Rows that
repeat an id or a text are documents of their own. Ties of the highest count all count as best. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .pieces import SPACE, STRETCH, PieceModel, batches_of
from .tokens import _BYTE_LEVEL

BYTE_TOKENIZER = "byte_bpe_50k.json"
#: Words after which a block ends.
BLOCK = 2_000_000
#: An id pair as one number: A's id shifted by so many bits, and B's.
B_BITS = 24


class ByteTokenizer:
    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(BYTE_TOKENIZER))
        self.tokenizer.encode_special_tokens = True
        number = {c: b for b, c in enumerate(_BYTE_LEVEL)}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(number[c] for c in token) if all(c in number for c in token) else token.encode()
        self.sizes = np.array([len(b) for b in self.bytes_of])

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def sums_of_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


class Aligner:
    """Stretches seen lately with their tokens' counts, groups and links; beyond `most` it starts anew (between blocks)."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None, most: int = 300_000):
        self.a, self.b, self.most = ByteTokenizer(a_path), PieceModel(b_path), most
        if self.b.n >> B_BITS:
            raise ValueError("B's ids don't fit")
        self.b_sizes = np.array([len(x) for x in self.b.bytes_of])
        decimals = lambda n, after: np.array([f"{i}{after}" for i in range(n)], object)
        self.a_more, self.a_last = decimals(len(self.a.bytes_of), ","), decimals(len(self.a.bytes_of), "|")
        self.b_more, self.b_last = decimals(self.b.n, ","), decimals(self.b.n, ";")
        self.start_anew()

    def start_anew(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def tables(self) -> tuple[np.ndarray, ...]:
        """n_a, n_b, n_groups, n_links (-1 where bytes differ) of each known stretch, and all links in a row."""
        if len(self.parts) > 1:
            self.parts = [tuple(map(np.concatenate, zip(*self.parts, strict=True)))]
        return self.parts[0] if self.parts else tuple(np.zeros(0, np.int64) for _ in range(5))

    def learn(self, stretches: set[str]) -> None:
        new = [s for s in stretches if s not in self.index]
        for at in range(0, len(new), 30_000):
            self.align(new[at : at + 30_000])

    def byte_ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all stretches in a row, and how many bytes each stretch has. Those that end in white space are read alone."""
        sizes = np.array([len(s.encode("utf-8", "replace")) for s in stretches])
        ids: list[int] = []
        held: list[str] = []
        for s in stretches:
            if s[-1].isspace() or not s[0].isspace() or s[-1] == "᠎":
                ids += self.a.encode("".join(held))
                ids += self.a.encode(s)
                held = []
            else:
                held.append(s)
                if len(held) == 1000:
                    ids += self.a.encode("".join(held))
                    held = []
        ids += self.a.encode("".join(held))
        return np.array(ids, np.int64), sizes

    def align(self, new: list[str]) -> None:
        odd = [s for s in new if SPACE in s]
        same = [s for s in new if SPACE not in s]
        if same:
            a_ids, sizes = self.byte_ids(same)
            b_lists = self.b.by_library(same)
            b_ids = np.fromiter(chain.from_iterable(b_lists), np.int64)
            raw = "".join(same).encode("utf-8", "replace")
            if raw != b"".join(map(self.a.bytes_of.__getitem__, a_ids.tolist())) or raw != b"".join(map(self.b.bytes_of.__getitem__, b_ids.tolist())):
                if len(same) > 1:  # find those whose bytes differ
                    self.align(new[: len(new) // 2])
                    self.align(new[len(new) // 2 :])
                    return
                odd, same = odd + same, []
        if same:
            a_ends, b_ends, ends = np.cumsum(self.a.sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]), np.cumsum(sizes)
            common = np.intersect1d(a_ends, b_ends, assume_unique=True)
            every = np.union1d(a_ends, b_ends)
            if not np.isin(ends, common).all():
                raise ValueError("a token reaches across stretches")
            links = a_ids[np.searchsorted(a_ends, every)] << B_BITS | b_ids[np.searchsorted(b_ends, every)]
            n_a, n_b, n_groups, n_links = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (a_ends, b_ends, common, every))
            self.parts.append((n_a, n_b, n_groups, n_links, links))
            # ids in decimals, group by group: A's, then B's, the last of each marked
            a_text = np.where(np.isin(a_ends, common), self.a_last[a_ids], self.a_more[a_ids])
            b_text = np.where(np.isin(b_ends, common), self.b_last[b_ids], self.b_more[b_ids])
            order = np.argsort(np.concatenate([np.searchsorted(common, a_ends) * 2, np.searchsorted(common, b_ends) * 2 + 1]), kind="stable")
            text = np.concatenate([a_text, b_text])[order].tolist()
            at = 0
            for s, n in zip(same, (n_a + n_b).tolist(), strict=True):
                self.index[s] = len(self.groups)
                self.groups.append("".join(text[at : at + n])[:-1])
                at += n
        if odd:
            none = np.zeros(len(odd), np.int64)
            self.parts.append((none, none, none, none - 1, none[:0]))
            for s in odd:
                self.index[s] = len(self.groups)
                self.groups.append("")


_shared: dict[tuple, Aligner] = {}


def shared_aligner(a_path: str | None, b_path: str | None) -> Aligner:
    """One for each worker process."""
    if (a_path, b_path) not in _shared:
        _shared[a_path, b_path] = Aligner(a_path, b_path)
    return _shared[a_path, b_path]


class Block:
    """Texts as numbers of stretches, until they are written."""

    def __init__(self):
        self.digests, self.copies, self.codes, self.lengths, self.shas, self.words = [], [], [], [], [], 0

    def add(self, digest: bytes, copies: int, codes: np.ndarray, sha: bytes) -> None:
        self.digests.append(digest)
        self.copies.append(copies)
        self.codes.append(codes)
        self.lengths.append(len(codes))
        self.shas.append(sha)
        self.words += max(1, len(codes))

    def written(self, aligner: Aligner) -> tuple[dict[str, bytes], np.ndarray, np.ndarray]:
        """The block's row, and its id pairs with their weighted counts."""
        n_a, n_b, n_groups, n_links, links = aligner.tables()
        lengths = np.array(self.lengths, np.int64)
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int64)
        used, own = np.unique(codes, return_inverse=True)
        weights = np.bincount(own, np.repeat(np.array(self.copies, np.int64), lengths), len(used)).astype(np.int64) if len(used) else used
        before = np.cumsum(np.maximum(n_links, 0)) - np.maximum(n_links, 0)
        my_links = links[ragged(before[used], n_links[used])]
        pairs, at = np.unique(my_links, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.repeat(weights, n_links[used]))
        totals = np.stack([sums_of_runs(x[codes], lengths) for x in (n_a, n_b, n_groups, n_links)]) if len(lengths) else np.zeros((4, 0), np.int64)
        row = {
            "digests": b"".join(self.digests), "shas": b"".join(self.shas), "totals": totals.astype("<i8").tobytes(), "lengths": lengths.astype("<i8").tobytes(),
            "codes": own.astype("<u4").tobytes(), "link_lengths": n_links[used].astype("<i4").tobytes(), "links": at.astype("<u4").tobytes(), "pairs": pairs.astype("<i8").tobytes(),
        }
        return row, pairs, counts


BODY = ["digests", "shas", "totals", "lengths", "codes", "link_lengths", "links", "pairs"]


def aligned_blocks(texts: DataFrame, a_path: str | None = None, b_path: str | None = None, block_words: int = BLOCK) -> DataFrame:
    """Rows of blocks of different texts (digest, text, copies): block and its body, or block, pair and how often its copies link that pair."""

    def align(given):
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, part, n = shared_aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        names = ["block", "pair", "n", *BODY]

        def rows(block: Block):
            row, pairs, counts = block.written(aligner)
            number = part << 32 | n
            body = [pa.array([row[k]], pa.binary()) for k in BODY]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *body], names)
            for at in range(0, len(pairs), 100_000):
                some = pairs[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), number), pa.int64()), pa.array(some, pa.int64()), pa.array(counts[at : at + 100_000], pa.int64()), *[pa.nulls(len(some), pa.binary()) for _ in BODY]], names
                )

        block = Block()
        for some in batches_of(given):
            if len(aligner.index) > aligner.most and not block.words:  # a block's numbers hold until it is written
                aligner.start_anew()
            cut = [STRETCH.findall(f" {r['text']}") if r["text"] else [] for r in some]
            aligner.learn(set(chain.from_iterable(cut)))
            fine, find, group = aligner.tables()[3] >= 0, aligner.index.__getitem__, aligner.groups.__getitem__
            for row, stretches in zip(some, cut, strict=True):
                codes = np.fromiter(map(find, stretches), np.int64, len(stretches))
                if not fine[codes].all():
                    codes = codes[:0]
                sha = hashlib.sha256(";".join(map(group, codes.tolist())).encode()).digest()
                block.add(row["digest"], row["copies"], codes, sha)
            if block.words >= block_words or len(aligner.index) > 2 * aligner.most:
                yield from rows(block)
                block, n = Block(), n + 1
        if block.digests:
            yield from rows(block)

    return texts.select("digest", "text", "copies").mapInArrow(align, "block long, pair long, n long, " + ", ".join(f"{k} binary" for k in BODY))


def measured(bodies: DataFrame, counted: DataFrame) -> DataFrame:
    """digest and measures of each text of the blocks (block and body), with the corpus-wide counts of their pairs (block, pair, total, best)."""

    def measure(left, right):
        import pyarrow as pa

        out = {k: [] for k in ("digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")}
        for row in left.to_pylist():
            get = lambda k, kind, row=row: np.frombuffer(row[k], kind)
            pairs, codes, links = get("pairs", "<i8"), get("codes", "<u4"), get("links", "<u4")
            at = np.searchsorted(pairs, right["pair"].to_numpy())
            total, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            total[at], best[at] = right["total"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
            lengths, link_lengths = get("lengths", "<i8"), get("link_lengths", "<i4").astype(np.int64)
            sums = [sums_of_runs(sums_of_runs(x[links], link_lengths)[codes], lengths) for x in (best, total)]
            totals = get("totals", "<i8").reshape(4, -1)
            out["digest"] += [row["digests"][k : k + 32] for k in range(0, len(row["digests"]), 32)]
            for k, v in zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), (*totals, *sums), strict=True):
                out[k] += v.tolist()
            out["groups_sha256"] += [row["shas"][32 * k : 32 * k + 32].hex() if n else "" for k, n in enumerate(lengths)]
        kinds = [pa.binary(), *[pa.int64()] * 6, pa.string()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    both = bodies.withColumnRenamed("block", "own_block").groupBy("own_block").cogroup(counted.groupBy("block"))
    return both.applyInArrow(measure, "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, total and best (whether no id of A is linked with its B id more often), from partial counts (pair, n)."""
    totals = stored(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    highest = totals.groupBy(b.alias("b")).agg(F.max("total").alias("highest"))  # a row for each id of B's vocabulary at most
    return totals.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "total", F.expr("total = highest").alias("best"))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_words: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    texts = docs.select(text_or_empty().alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(digest, "text", "copies")
    made = stored(aligned_blocks(texts, a_path, b_path, block_words), "aligned", "zstd")
    pairs = made.where("pair IS NOT NULL").select("block", "pair", "n")
    counted = pairs.select("block", "pair").join(pair_counts(pairs.select("pair", "n")), "pair").select("block", "pair", "total", "best")
    measures = stored(measured(made.where("pair IS NULL").select("block", *BODY), counted), "measures")
    return docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", digest).join(measures, "digest").drop("digest")
