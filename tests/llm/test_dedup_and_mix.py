"""Exact dedup, near dedup and mixing against brute force, with nulls, ties, long and empty texts and odd columns."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from proofgrid.llm import exact_dedup, mixing, near_dedup
from proofgrid.llm.common import shingle_hashes, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, class_id string, content string, salt string"
ODD = [
    (1, "a  b\tc", "en", "s1", 6, "x", "y", "z", "w"), (2, "a b c", "en", None, 5, "x", "y", "z", "w"), (3, None, None, "s2", None, None, None, None, None), (4, "", "en", "s1", 0, None, None, None, None),
    (5, " ", "en", "s1", 1, None, None, None, None), (None, "a b c", "en", "s1", 5, None, None, None, None), (None, "only null", "en", "s3", 9, None, None, None, None), (6, "long " * 30000, "en", "s2", 1, None, None, None, None),
    (2, "a b c", "en", None, 5, "x", "y", "z", "w"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_exact_dedup_matches_brute_force(odd):
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(odd).collect())
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t[1] or "") for t in ODD]
    want = []
    for row, text in zip(ODD, norm, strict=True):
        ids = [r[0] for r, t in zip(ODD, norm, strict=True) if t == text]
        keep = min([i for i in ids if i is not None], default=None)
        want.append((row[0] or -1, keep or -1, len(ids), row[0] == keep, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_hash_collisions_do_not_merge(odd):
    plain = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(odd).collect()}
    weak = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(odd, hash_column=F.lit("same")).collect()}
    assert plain == weak


def test_keep_first_has_each_text_once(odd):
    rows = exact_dedup.keep_first(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "3", "5", "6", "None"]
    assert set(rows[0].asDict()) == {c.split()[0] for c in SCHEMA.split(", ")}


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, near_dedup.near_dedup, mixing.mix_totals, exact_dedup.keep_first, near_dedup.keep_one, mixing.mixed_documents])
def test_empty_tables(odd, operator):
    assert operator(odd.limit(0)).collect() == []


def corpus(seed=7):
    """Random texts, copies of them with few edits, copies with many, and short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = [[word() for _ in range(rng.randint(30, 120))] for _ in range(25)]
    out = [list(d) for d in docs]
    for d in docs[:12]:
        for edits in (1, 3, len(d) // 2):
            e = list(d)
            for _ in range(edits):
                at = rng.randrange(len(e))
                kind = rng.choice("ids")
                e[at : at + (kind != "i")] = [] if kind == "d" else [word()]
            out.append(e)
    out += [["one"], ["one"], ["two", "words"], [], []]
    return [" ".join(x) for x in out]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_near_classes_match_all_pairs(spark):
    texts = corpus()
    words = [t.split() for t in texts]
    best = list(range(len(texts)))
    near = lambda a, b: edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
    changed = True
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near(words[i], words[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(best[i], best[j])
            changed |= best[i] != low or best[j] != low
            best[i] = best[j] = low
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(best))


def test_banded_edits_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        a, b = [[str(rng.randrange(4)) for _ in range(rng.randrange(14))] for _ in range(2)]
        x, y = word_hashes(" ".join(a)), word_hashes(" ".join(b))
        want, most = edits(a, b), rng.randrange(0, 12)
        assert near_dedup.banded_edits(x, y, most) == (want if want <= most else None)


def test_order_minhash_heeds_order_and_occurrence():
    a, b = [word_hashes(" ".join(f"w{i}" for i in order)) for order in (range(60), reversed(range(60)))]
    same = (near_dedup.order_minhash(a) == near_dedup.order_minhash(a.copy())).all()
    assert same and not (near_dedup.order_minhash(a) == near_dedup.order_minhash(b)).any()
    labelled = near_dedup.occurrence_labelled(shingle_hashes(word_hashes("x y z x y z x y z x y z"), 3))
    assert len(set(labelled.tolist())) == len(labelled)


def test_near_dedup_of_odd_rows(odd):
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"]) for r in near_dedup.near_dedup(odd).collect())
    assert got == sorted([("1", "1", True), ("2", "1", False), ("2", "1", False), ("None", "1", False), ("3", "3", True), ("4", "3", False), ("5", "3", False), ("6", "6", True), ("None", "None", True)])


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target = share * sum(sizes.values()), {}
    free = set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mix_matches_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 300))), rng.choice(["é", "a", "b", None, "zz"] + ["hot"] * 4)) for i in range(400)]
    got = mixing.mix_totals(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix_totals(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    sizes, taken = {}, {}
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = water(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    width = mixing.block_width(sum(want.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 * width
    assert len(got) == len(rows)


def test_slots_decide_what_is_taken(spark):
    """Other points give another mix: what a source's slots hold is what is taken, up to the end of its tape."""
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 90)), f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    uneven = lambda slots: slots.withColumn("point", F.lit(0.99))
    for points in (mixing.golden_points, uneven):
        pieces = mixing.mix_sources(docs, points=points).collect()
        size = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in ("s0", "s1", "s2")}
        width = mixing.block_width(1.5 * sum(size.values()))
        for s in size:
            mine = [p for p in pieces if p["source"] == s]
            slots = {p["slot"] for p in mine if p["slot"] is not None}
            assert sum(p["words"] for p in mine) == min(width * len(slots), 2 * size[s])
            assert all(sum(p["words"] for p in mine if p["slot"] == k) <= width for k in list(slots)[:50])
        want = water(size)
        near = all(abs(sum(p["words"] for p in pieces if p["source"] == s) - want[s]) <= 3 * width for s in size)
        assert near == (points is mixing.golden_points)


def test_mix_comes_in_the_order_of_its_slots(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20)), f"s{i % 4}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {}
    for p in mixing.mix_sources(docs).where("words > 0").collect():
        key = (p["doc_id"], p["copy"])
        first[key] = min(first.get(key, 1 << 60), p["slot"])
    got = [r["doc_id"] for r in mixing.mixed_documents(docs).collect()]
    assert got == [d for (d, c), s in sorted(first.items(), key=lambda x: (x[1], x[0][1]))]


def test_stages_keep_rows_without_or_with_equal_ids(spark):
    rows = [(None, "alpha beta gamma", "a"), (None, "delta epsilon zeta", "a"), (None, "eta theta iota kappa", "b"), (7, "lambda mu nu", "b"), (7, "xi omicron pi rho", "b"), (7, "xi omicron pi rho", "b"), (8, "lambda  mu nu", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in near_dedup.keep_one(docs).collect())
    assert kept == sorted([("None", rows[0][1]), ("None", rows[1][1]), ("None", rows[2][1]), ("7", rows[3][1]), ("7", rows[4][1])])
    classes = near_dedup.near_dedup(docs).collect()
    assert len(classes) == len(rows) and [r["class_id"] for r in classes if r["doc_id"] == 8] == [7]
    words = sum(len(r["text"].split()) for r in mixing.mixed_documents(docs).collect())
    assert words == sum(r["taken"] for r in mixing.mix_totals(docs).collect())
    assert {r["text"].split()[0] for r in mixing.mixed_documents(docs).collect()} == {r[1].split()[0] for r in rows}


def test_near_null_ids_leave_one(spark):
    body = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(body)), (None, " ".join(body[:-1] + ["x"])), (None, " ".join(body) + " "), (None, "other words entirely here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(near_dedup.keep_one(docs).collect()) == 2 and sum(r["kept"] for r in near_dedup.near_dedup(docs).collect()) == 2


def test_mixed_documents_have_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5 + i % 50)), f"s{i % 4}", "en", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_totals(docs).collect()}
    out = {}
    for r in mixing.mixed_documents(docs).collect():
        assert r["n_chars"] == len(r["text"]) and rows[r["doc_id"]][1].startswith(r["text"])
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + len(r["text"].split())
    assert out == {k: v for k, v in taken.items() if v}


def test_mix_of_odd_rows(odd):
    got = mixing.mix_totals(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(1, 600_000.0), (2, 300_000.0), (3, 100_000.0)], "place int, target double")
    slots = mixing.schedule(targets, 1000).orderBy("slot").collect()
    for upto in (50, 200, 1000):
        for place, part in ((1, 0.6), (2, 0.3), (3, 0.1)):
            assert abs(sum(s["place"] == place for s in slots[:upto]) - part * upto) <= 4
    nth = [s["nth"] for s in slots if s["place"] == 1]
    assert nth == list(range(len(nth)))


def test_mixed_documents_group_texts_only_if_rows_repeat(spark):
    rows = [(k, f"w{k} " * (1 + k % 7), f"s{k % 3}") for k in range(60)]
    once = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    twice = mixing.mixed_documents(spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string"))
    grouped = lambda df: "Aggregate" in df._jdf.queryExecution().optimizedPlan().toString()
    assert grouped(twice) and not grouped(once)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_totals(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    words = dict.fromkeys(taken, 0)
    for r in once.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == taken
