"""SentencePiece merge vocabularies: encoding by a score-ordered agenda of adjacent symbol pairs, decoding, and the check against the library.

A text is U+2581 (the dummy prefix) and its characters, spaces as U+2581. Of all adjacent pairs of symbols whose joined
string is a piece, that with the highest score is merged first, of equal scores the leftmost, until none is left; a
character outside the vocabulary becomes the byte pieces of its UTF-8. As no piece reaches across a CUT (white space that
starts a run, kept with what follows it), each stretch between cuts has its ids wherever it stands, so different stretches
are encoded once in a while and looked up in between. Each Arrow batch's new stretches go through the agenda together, and
through the sentencepiece library for the check; a difference raises.

Nulls, ties and odd input: a null text is empty and has no ids; ties of doc_id don't matter, every row is on its own;
an empty table gives an empty result; texts are whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import text_or_empty

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: White space at which stretches begin, if nothing white (or U+2581) stands before it. Old tables also count U+180E as white.
CUT = " \n\t"
_WHITE, _ODD = f"[\\s\u180e{SPACE}]", f"(?:(?![{CUT}])[\\s\u180e{SPACE}])"
STRETCH = re.compile(f"{_WHITE}*[^\\s\u180e{SPACE}]+(?:{_ODD}{_WHITE}*[^\\s\u180e{SPACE}]*)*|{_WHITE}+")
#: Longer stretches have an agenda of their own, a heap.
LONG = 48
_NONE = np.iinfo(np.int64).max


class PieceModel:
    """The vocabulary of a merge-type model as tables: characters to symbols, pairs of symbols to merged ones in order of score."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        n = sp.vocab_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        if any(c in self.names[i] for i in plain for c in CUT) or any(SPACE in self.names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece reaches across white space")
        of_bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(of_bytes) < 256:
            raise ValueError("the model has no byte pieces")
        self.byte_ids = [of_bytes[b] for b in range(256)]
        self.bytes_of = [self.names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in of_bytes.items():
            self.bytes_of[i] = bytes([b])
        self.n = n
        id_of = {self.names[i]: i for i in plain}
        self.of_char = np.full(0x110000, n, np.int32)  # n stands for any character outside the vocabulary
        for name, i in id_of.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        self.of_char[ord(" ")] = self.of_char[ord(SPACE)]
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        pairs = {}
        for name, i in id_of.items():
            for at in range(1, len(name)):
                a, b = id_of.get(name[:at]), id_of.get(name[at:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = (rank[sp.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)

    def found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (of the score, the highest first) and merged symbol of pairs; _NONE where they make no piece."""
        key = a.astype(np.int64) * (self.n + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def by_heap(self, symbols: list[int]) -> list[int]:
        """Indexes of the symbols that are left, with the merged ones put in place."""
        n, pairs, base = len(symbols), self.pairs, self.n + 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (hit := pairs.get(symbols[i] * base + symbols[j])):
                heapq.heappush(agenda, (hit[0], i, j, symbols[i], symbols[j], hit[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b, new = heapq.heappop(agenda)
            if symbols[i] != a or after[i] != j or symbols[j] != b:
                continue  # one of the two has gone into another merge
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [i for i in range(n) if symbols[i] >= 0]

    def spelled(self, symbols: list[int], at: list[int], stretch: str) -> list[int]:
        """The ids of the symbols left, characters outside the vocabulary as bytes."""
        out = []
        for i in at:
            out += [symbols[i]] if symbols[i] < self.n else [self.byte_ids[b] for b in stretch[i].encode("utf-8", "replace")]
        return out

    def encode_stretches(self, stretches: list[str]) -> list[list[int]]:
        """The ids of each stretch (as it stands, without a prefix): one agenda for all short ones, of which every round takes the best pair of each."""
        out: list[list[int] | None] = [None] * len(stretches)
        short = [k for k, s in enumerate(stretches) if len(s) <= LONG]
        for k, s in enumerate(stretches):
            if len(s) > LONG:
                symbols = self.of_char[np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)].tolist()
                out[k] = self.spelled(symbols, self.by_heap(symbols), s)
        if not short:
            return out
        lengths = np.array([len(stretches[k]) for k in short])
        points = np.frombuffer("".join([stretches[k] for k in short]).encode("utf-32-le", "replace"), np.uint32)
        symbols = np.append(self.of_char[points], np.int32(self.n))
        total = len(points)
        starts = np.cumsum(lengths) - lengths
        last = np.zeros(total, bool)
        last[starts + lengths - 1] = True
        places = np.arange(total)
        after, before = np.append(places + 1, 0), np.append(places - 1, 0)
        after[:-1][last], before[starts] = total, total
        key, to = self.found(symbols[:-1], symbols[1:])
        key[last] = _NONE
        agenda = np.append(np.where(key == _NONE, _NONE, key * total + places), _NONE)  # score first, then place
        to, alive = np.append(to, np.int32(0)), np.ones(total + 1, bool)
        held, first = agenda[:total], starts  # the agenda of the stretches that are still merging, and where each begins in it
        where = places
        while len(first):
            best = np.minimum.reduceat(held, first)
            going = best != _NONE
            i = best[going] % total
            j = after[i]
            symbols[i], after[i], alive[j] = to[i], after[j], False
            before[after[i]] = i
            for a, b in ((i, after[i]), (before[i], i)):
                inside = (a < total) & (b < total)
                rank, new = self.found(symbols[a], symbols[b])
                rank = np.where(inside & (rank != _NONE), rank * total + a, _NONE)
                agenda[a], to[a] = rank, new
            agenda[j] = agenda[total] = _NONE
            sizes = np.diff(np.append(first, len(held)))
            keep = np.repeat(going, sizes) & alive[where]
            where = where[keep]
            held = agenda[where]
            sizes = np.add.reduceat(keep, first)[going]
            first = np.cumsum(sizes) - sizes
        left = np.flatnonzero(alive[:total])
        ends = np.searchsorted(left, starts + lengths).tolist()
        ids, begin, odd = symbols[left].tolist(), 0, symbols[left] == self.n
        strange = set(np.searchsorted(np.array(ends), np.flatnonzero(odd), "right").tolist()) if odd.any() else ()
        offsets = starts.tolist()
        for k, (own, end) in enumerate(zip(short, ends, strict=True)):
            out[own] = ids[begin:end]
            if k in strange:
                at = [int(x) - offsets[k] for x in left[begin:end]]
                out[own] = list(chain.from_iterable([s] if s < self.n else [self.byte_ids[b] for b in stretches[own][x].encode("utf-8", "replace")] for s, x in zip(ids[begin:end], at, strict=True)))
            begin = end
        return out

    def by_library(self, stretches: list[str]) -> list[list[int]]:
        """The library's ids of stretches. It puts U+2581 before what it is given, which stands for a stretch's own first space."""
        spaced = [s.startswith(" ") for s in stretches]
        found = self.library.encode([s[1:] if x else s for s, x in zip(stretches, spaced, strict=True)], num_threads=1)
        return [(ids if len(s) > 1 else [int(self.of_char[ord(SPACE)])]) if x else ids[1:] for s, x, ids in zip(stretches, spaced, found, strict=True)]

    def checked(self, stretches: list[str], ids: list[list[int]]) -> None:
        """Raises unless the library gives the same ids."""
        for s, own, other in zip(stretches, ids, self.by_library(stretches), strict=True):
            if own != other:
                raise ValueError(f"{s!r}: the agenda gives {own}, the library {other}")


class PieceTokenizer:
    """Holds the ids of stretches seen lately, as decimals: beyond `most` it starts anew, taking over those of the lot before that come again."""

    def __init__(self, path: str | None = None, most: int = 300_000, check: bool = True):
        self.model, self.most, self.check = PieceModel(path), most, check
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}

    def learn(self, stretches: set[str]) -> None:
        if len(self.known) + len(stretches) > self.most:
            self.known, self.before = {}, self.known
        new = []
        for s in stretches.difference(self.known):
            if (ids := self.before.get(s)) is None:
                new.append(s)
            else:
                self.known[s] = ids
        for at in range(0, len(new), 30_000):
            some = new[at : at + 30_000]
            ids = self.model.encode_stretches(some)
            if self.check:
                self.model.checked(some, ids)
            self.known.update(zip(some, [",".join(map(str, x)) for x in ids], strict=True))

    def decimals(self, texts: list[str]) -> list[str]:
        """The ids of each text in decimals, joined by commas."""
        cut = [STRETCH.findall(f" {t}") if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        find = self.known.__getitem__
        return [",".join(map(find, c)) for c in cut]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.fromstring(x, np.int32, sep=",").tolist() if x else [] for x in self.decimals(texts)]

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids: bytes of pieces in a row, the dummy prefix dropped, broken UTF-8 as U+FFFD."""
        return self.model.library.decode(ids)


_shared: dict[str | None, PieceTokenizer] = {}


def shared_pieces(path: str | None = None) -> PieceTokenizer:
    """One for each worker process."""
    if path not in _shared:
        _shared[path] = PieceTokenizer(path)
    return _shared[path]


def batches_of(given, most_chars: int = 2_000_000):
    """Lists of rows from Arrow batches, cut where their texts reach most_chars, so that a list holds one text more at most."""
    for batch in given:
        rows, size = [], 0
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                rows.append(row)
                size += len(row["text"])
                if size >= most_chars:
                    yield rows
                    rows, size = [], 0
        if rows:
            yield rows


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (all ids of the whole text) and decoded (the library's text of them) of every row of docs (doc_id, text)."""

    def encode(given):
        import pyarrow as pa

        tokenizer = shared_pieces(path)
        for rows in batches_of(given):
            ids = tokenizer.encode_batch([r["text"] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(tokenizer.decode, ids), pa.string())], ["doc_id", "ids", "decoded"]
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of every row of docs, digested where they are made."""

    def encode(given):
        import pyarrow as pa

        tokenizer = shared_pieces(path)
        for rows in batches_of(given):
            out = []
            for row, ids in zip(rows, tokenizer.decimals([r["text"] for r in rows]), strict=True):
                text = tokenizer.decode(np.fromstring(ids, np.int32, sep=",").tolist()) if ids else ""
                out.append((row["doc_id"], ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64() if k < 2 else pa.string()) for k, v in enumerate(zip(*out, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
