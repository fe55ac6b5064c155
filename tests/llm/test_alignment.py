"""Alignment of two tokenizers against a plain loop over whole texts and the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from proofgrid.llm import alignment, queries
from proofgrid.llm.tokens import _BYTE_LEVEL


def tokens(text, a, b):
    """Ids and byte ends of A and B, or nothing where their bytes aren't the text's."""
    raw = f" {text}".encode()
    a_ids = a.encode(f" {text}", add_special_tokens=False).ids
    a_bytes = [bytes(_BYTE_LEVEL.index(c) for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, b_ids)]
    if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return []
    out = []
    for ids, parts in ((a_ids, a_bytes), (b_ids, b_bytes)):
        at, ends = 0, []
        for p in parts:
            ends.append((at, at := at + len(p)))
        out.append((ids, ends))
    return out


def brute(rows):
    """The contract's rows by loops over all tokens of all documents."""
    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_TOKENIZER))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    links, digests, corpus = [], [], Counter()
    for _, text in rows:
        found = tokens(text or "", a, b)
        if not found:
            links.append([])
            digests.append((0, 0, 0, ""))
            continue
        (a_ids, a_at), (b_ids, b_at) = found
        mine = [(a_ids[i], b_ids[j]) for i, (s, e) in enumerate(a_at) for j, (t, u) in enumerate(b_at) if s < u and t < e]
        common = sorted({e for _, e in a_at} & {e for _, e in b_at})
        groups, low = [], 0
        for cut in common:
            part = lambda ids, at: ",".join(str(i) for i, (s, _) in zip(ids, at, strict=True) if low <= s < cut)  # noqa: B023, E731
            groups.append(f"{part(a_ids, a_at)}|{part(b_ids, b_at)}")
            low = cut
        links.append(mine)
        corpus.update(mine)
        digests.append((len(a_ids), len(b_ids), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = Counter()
    for (_, y), n in corpus.items():
        highest[y] = max(highest[y], n)
    return [
        (doc_id, n_a, n_b, n_g, len(mine), sum(corpus[p] == highest[p[1]] for p in mine), sum(corpus[p] for p in mine), sha)
        for (doc_id, _), mine, (n_a, n_b, n_g, sha) in zip(rows, links, digests, strict=True)
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
WORDS = ["the", "quick", "naïve", "é", "中文", "😀", "don't", "x=1;", "12345", "​", "<|endoftext|>", "</s>", "antidisestablishment", "᠎", "\x1c"]
GAPS = [" ", "  ", "   ", "\n", "\r\n", "\t", " \n ", "　", "\xa0", "\r", "\x85 "]


def odd_rows(n):
    rng = random.Random(8)
    texts = ["".join(rng.choice(WORDS) + rng.choice(GAPS) * rng.randrange(2) for _ in range(rng.randrange(30))) for _ in range(n)]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(32, 127)))) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [None, "", " ", "   ", "\n", "a▁b", "▁", "same text", "same text", "same text ", "<0x41>", *texts, *texts[: n // 3]]


def test_alignment_against_loops(spark, tmp_path):
    rows = [(k // 2 if k > 3 else None, t) for k, t in enumerate(odd_rows(120))]
    want = brute(rows)
    wide = [(*r, "x", 1) for r in rows]
    spark.createDataFrame(wide, "doc_id long, text string, digest string, total int").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_alignment(spark, str(tmp_path)).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_blocks_of_any_size_agree(spark):
    docs = spark.createDataFrame(list(enumerate(odd_rows(60))), "doc_id long, text string").repartition(3)
    rows = lambda words: sorted(map(tuple, alignment.align_documents(docs, block_words=words).select(*COLUMNS).collect()))
    assert rows(1) == rows(200) == rows(alignment.BLOCK) == sorted(brute([tuple(r) for r in docs.collect()]))


def test_stretches_known_before_are_forgotten():
    aligner = alignment.Aligner(most=10)
    aligner.learn({" a", " b\n", " c▁"})
    assert [n.tolist() for n in aligner.tables()[:4]] == [[1, 2, 0], [1, 2, 0], [1, 2, 0], [1, 2, -1]] or sorted(aligner.tables()[3].tolist()) == [-1, 1, 2]
    aligner.start_anew()
    assert aligner.index == {} and len(aligner.tables()[4]) == 0


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
