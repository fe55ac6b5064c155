"""Encoding with a merge-type vocabulary against the library, on odd texts and through the query."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from proofgrid.llm import pieces, queries

WORDS = ["the", "in", "quick", "naïve", "é", "ß", "中文", "😀", "don't", "x=1;", "(a)", "1234", "\x00", "\x85", "​", "᠎", "<0x41>", "</s>", "▁"]
GAPS = [" ", "  ", "   ", "     ", "\n", "\r\n", "\t", " \n ", "　", " ", " ▁ ", "▁", "\r"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


@pytest.fixture(scope="module")
def tokenizer():
    return pieces.PieceTokenizer(most=5000)


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    made = ["".join(rng.choice(rng.choice((WORDS, GAPS))) for _ in range(rng.randrange(40))) for _ in range(n)]
    return made + ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x11000), rng.randrange(32, 127)))) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equals_library_on_odd_texts(tokenizer, library):
    texts = odd_texts(6000)
    ids = library.encode(texts)
    assert tokenizer.encode_batch(texts) == ids
    assert tokenizer.encode_batch(texts[:50]) == ids[:50]  # after the known stretches began anew
    assert [tokenizer.decode(x) for x in ids] == library.decode(ids)


def test_long_stretches_use_the_same_order(tokenizer, library):
    texts = ["abc" * 5000, " " * 3000 + "x", "aaaa" * 700, "\n" * 500, "中" * 400]
    assert tokenizer.encode_batch(texts) == library.encode(texts)
    short = [s for t in odd_texts(300) for s in pieces.STRETCH.findall(t)]
    model = tokenizer.model
    by_round = model.encode_stretches(short)
    for s, ids in zip(short, by_round, strict=True):
        symbols = [int(model.of_char[ord(c)]) for c in s]
        assert model.spelled(symbols, model.by_heap(symbols), s) == ids


def test_a_difference_raises(tokenizer):
    with pytest.raises(ValueError, match="the agenda gives"):
        tokenizer.model.checked([" word"], [[5]])


def test_query_on_odd_rows(spark, tmp_path, library):
    texts = [None, "", " ", "a", "a", "b " * 40000, *odd_texts(40)]
    texts = [t if t is None else t.replace("\x00", "") for t in texts]
    rows = [(k // 2 if k > 1 else None, t, "x", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens long").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    got = [tuple(r) for r in queries.op11_pieces(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.piece_digests(empty).collect() == [] and pieces.encode_documents(empty).collect() == []
    full = pieces.encode_documents(spark.createDataFrame([(1, "hello there")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in full] == [(1, library.encode("hello there"), "hello there")]
