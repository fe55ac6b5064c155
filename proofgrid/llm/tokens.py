"""Encoding texts with a public tokenizer file, each different word once in a while instead of every time.

No token of these vocabularies reaches across ASCII white space, which the tokenizer drops, so the ids of a text are those
of its white-space separated words in order. A new word goes through the library's own steps: normaliser, split into
pieces (runs of letters, digits, runs of signs), merges. Most words need no more of the first two than lower case and one
pattern; the others are left to the library.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

import numpy as np

TOKENIZER = "word_bpe_49k.json"
VOCABULARY = 49408
END_ID = 2

#: Words of printable Latin-1 alone: lower case, composition and the letters in it are plain there.
_PLAIN = re.compile("[!-~\xc0-\xff]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Byte-level alphabet: visible Latin-1 stands for itself, each other byte in order for the next sign from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = iter(range(256, 512))
_BYTE_LEVEL = "".join(chr(b if b in _VISIBLE else next(_OTHERS)) for b in range(256))


class WordIds(dict):
    """The ids (uint32, little-endian) of words in UTF-8, found by the library at first sight."""

    def __init__(self, tokenizer, specials: list[bytes], before: dict[bytes, bytes]):
        super().__init__()
        self.tokenizer, self.specials, self.before, self.merged = tokenizer, specials, before, tokenizer.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = self.before.pop(word, None) or self.found(word)
        return ids

    def found(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self.merge(word.decode().lower())
        if b"<|" in word and any(s in word for s in self.specials):
            return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        text = word.decode()
        if _PLAIN.fullmatch(text):
            pieces = _PIECES.findall(text.lower())
            if len(pieces) == 1:
                return self.merge(charmap_decode(pieces[0].encode(), "strict", _BYTE_LEVEL)[0])
            return b"".join([self[p.encode()] for p in pieces])
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return b"".join([self.merge(piece) for piece, _ in split])

    def merge(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.merged(piece)]).tobytes()


class WordTokenizer:
    """Holds the ids of words seen lately: beyond `most` it starts anew, taking over those of the lot before that come again."""

    def __init__(self, path: str | None = None, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.known = WordIds(self.tokenizer, self.specials, {})

    def encode(self, text: str, end_id: int | None = END_ID) -> np.ndarray:
        """The ids of the whole text as uint32, with end_id appended."""
        raw = text.encode("utf-8", "replace")
        # the tokenizer lowers every character by itself; special tokens are matched before that
        words = raw.split() if b"<|" in raw else raw.lower().split()
        if len(self.known) > self.most:
            self.known.before.clear()
            self.known = WordIds(self.tokenizer, self.specials, self.known)
        ids = b"".join(map(self.known.__getitem__, words))
        return np.frombuffer(ids if end_id is None else ids + np.array([end_id], "<u4").tobytes(), np.uint32)


_shared: dict[str | None, WordTokenizer] = {}


def shared_tokenizer(path: str | None = None) -> WordTokenizer:
    """One for each worker process."""
    if path not in _shared:
        _shared[path] = WordTokenizer(path)
    return _shared[path]
