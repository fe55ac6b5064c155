"""Alike names against all pairs of a block; entity pairs against a loop."""

import difflib
import random

import pytest

from proofgrid.operators import entities, matching

ROWS = "id long, name string, block string, score double, piece int"


def brute(rows, threshold):
    names = {}
    for i, name, block, *_ in rows:
        norm = (name or "").strip(" ").lower()
        if norm:
            names[block, norm] = min(i, names.get((block, norm), i))
    out = []
    for (block, a), i in names.items():
        for (other, b), j in names.items():
            if block == other and i < j and (score := round(difflib.SequenceMatcher(None, a, b).ratio(), 4)) >= threshold:
                out.append((i, j, score))
    return sorted(out)


def varied(rng, name):
    letters = list(name)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(letters) + 1)
        letters[at : at + rng.randrange(2)] = rng.choice(("", "x", "é", " ", "ab"))
    return "".join(letters)


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85, 0.93])
def test_alike_names_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    stems = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 30))) for _ in range(12)]
    rows = [(k, varied(rng, rng.choice(stems)), rng.choice(("p", "q", None)), 0.0, 1) for k in range(150)]
    rows += [(900, None, "p", 0.0, 1), (901, "  ", "p", 0.0, 1), (902, "A", "p", 0.0, 1), (903, "a ", "p", 0.0, 1), (904, "ab", "p", 0.0, 1), (905, "aab", "p", 0.0, 1)]
    got = sorted((r["left_id"], r["right_id"], r["score"]) for r in matching.alike(spark.createDataFrame(rows, ROWS), ["block"], threshold).collect())
    want = brute(rows, threshold)
    assert want and got == want


def test_no_names(spark):
    assert matching.alike(spark.createDataFrame([], ROWS), ["block"], 0.85).collect() == []


def test_unlike_names_of_one_block_do_not_meet(spark):
    """Names of different words: what meets is far from the square of the block."""
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)), "p", 0.0, 1) for k in range(600)]
    names = spark.createDataFrame(rows, ROWS).selectExpr("id", "name", "block", "length(name) AS n")
    met = matching.meeting(names, ["block"], matching.character_pairs(names["name"]), matching.needed_pairs(names["n"], 0.85)).count()
    assert met < 600 * 600 / 2 * 0.5


def test_entity_pairs_against_a_loop(spark):
    rng = random.Random(3)
    kinds = ("organization", "person", "domain")
    rows = [(k, rng.choice(kinds), rng.choice(("Acme Inc.", "ACME inc", "Acme  Incorporated", "www.acme.org.", "acme.org", "Jane Doe", "jane. doe", "", None)), rng.randrange(3), rng.choice("xy"), rng.choice((None, "", "US", "DE"))) for k in range(60)]
    frame = spark.createDataFrame(rows, "id long, kind string, name string, n_evidence int, block string, country string")
    got = sorted(tuple(r) for r in entities.matched_pairs(frame, ["block"], ["country"]).collect())

    def norm(kind, name):
        v = (name or "").strip().lower()
        if kind == "domain":
            return v.removeprefix("www.").rstrip(".")
        return " ".join(v.replace(".", " ").split())

    want = []
    for i, kind, name, n, block, country in rows:
        for j, other, second, m, where, land in rows:
            a, b = norm(kind, name), norm(other, second)
            if i >= j or kind != other or block != where or not a or not b:
                continue
            score = 1.0 if a == b else round(difflib.SequenceMatcher(None, a, b).ratio(), 4)
            score = round(min(1.0, score + 0.05 * bool(country and country == land)), 4)
            sure = n + m >= 2
            state = "UNRESOLVED" if kind == "person" and score < 1 and not sure else "VERIFIED_MATCH" if score >= 1 and sure else "PROBABLE_MATCH" if score >= 0.93 else "POSSIBLE_MATCH" if score >= 0.85 else "UNRESOLVED" if score >= 0.6 else "LIKELY_DISTINCT"
            want.append((i, j, score, state))
    assert got == sorted(want)
