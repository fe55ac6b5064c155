"""Near dedup where candidates are hard to find: many texts with one passage, and edits as dense as the threshold allows."""

import itertools
import random

import numpy as np
import pytest

from proofgrid.llm import near_dedup
from proofgrid.llm.common import word_hashes


def classes(spark, texts):
    rows = near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: r["class_id"] for r in rows}


def test_texts_of_one_passage_meet_all_others(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, texts = [word() for _ in range(150)], []
    for k in range(60):
        own = [word() for _ in range(50)]
        texts.append(passage + own)
        if k < 20:  # every second own word is another: no run of words but the passage is in common
            texts.append(passage + [w if i % 2 else word() for i, w in enumerate(own)])
    rng.shuffle(texts)
    words = [word_hashes(" ".join(t)) for t in texts]
    want = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if near_dedup.near(words[i], words[j]):
            want[j] = want[i]
    assert len(set(want)) == 60
    assert classes(spark, [" ".join(t) for t in texts]) == dict(enumerate(want))


def edited(rng, words, share, scattered):
    n = int(share * len(words) + 1e-9)
    at = set(rng.sample(range(len(words)), n) if scattered else range(len(words) // n // 2, len(words), len(words) // n))
    return [f"x{rng.randrange(10**9)}" if k in at else w for k, w in enumerate(words)]


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_recall_at_dense_edits(spark, share):
    rng = random.Random(5)
    kinds, texts = [], []
    for n, scattered in itertools.product((20, 40, 200), (True, False)):
        for _ in range(50):
            words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            kinds.append((n, scattered))
            texts += [" ".join(words), " ".join(edited(rng, words, share, scattered))]
    got = classes(spark, texts)
    found = {k: 0 for k in kinds}
    for p, k in enumerate(kinds):
        found[k] += got[2 * p + 1] == 2 * p
    print(share, found)
    assert all(n >= 48 for n in found.values())


@pytest.mark.parametrize("n,own,edits", [(500, 48, 26), (1650, 48, 26)])
def test_passage_and_few_different_words(spark, n, own, edits):
    """One passage in every text, own words from a vocabulary of 200: no word is rare, and planted pairs differ in half of their own words."""
    rng = random.Random(n + edits)
    words, passage = [f"w{k}" for k in range(200)], [f"p{rng.randrange(10**6)}" for _ in range(152)]
    texts, pairs = [], []
    for k in range(n):
        mine = [rng.choice(words) for _ in range(own)]
        texts.append(passage + mine)
        if k < 150:
            other = list(mine)
            for at in rng.sample(range(own), edits):
                other[at] = rng.choice(words)
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(passage + other)
    got = classes(spark, [" ".join(t) for t in texts])
    hashes = [word_hashes(" ".join(t)) for t in texts]
    assert all(near_dedup.near(hashes[a], hashes[b]) for a, b in pairs)
    found = sum(got[a] == got[b] for a, b in pairs)
    print(n, edits, found)
    assert found == len(pairs)
    assert len(set(got.values())) > n * 0.9


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_banded_edits_against_the_whole_table():
    rng = random.Random(0)
    for _ in range(6000):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        most, want = rng.randrange(8), plain_edits(a, b)
        assert near_dedup.banded_edits(np.array(a, np.uint64), np.array(b, np.uint64), most) == (want if want <= most else None)


@pytest.mark.parametrize("star", [512, 64])
def test_pairs_that_share_no_mark(spark, monkeypatch, star):
    """One passage in every text; planted pairs keep each fifth of their own words, all common, so that no rare word and no word pair is in both. star: texts of a block."""
    monkeypatch.setattr(near_dedup, "STAR", star, raising=False)
    rng = random.Random(4)
    words, passage, texts = [f"w{k}" for k in range(200)], [f"p{k}" for k in range(152)], []
    for _ in range(200):
        mine = [rng.choice(words) for _ in range(48)]
        texts.append(passage + mine)
        if len(texts) % 3 == 1:
            texts.append(passage + [w if at % 5 == 0 else rng.choice(words) for at, w in enumerate(mine)])
    hashes = [word_hashes(" ".join(t)) for t in texts]
    want = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if near_dedup.near(hashes[i], hashes[j]):
            want = [want[i] if c == want[j] else c for c in want]
    assert 180 < len(set(want)) <= 205
    assert classes(spark, [" ".join(t) for t in texts]) == dict(enumerate(want))
