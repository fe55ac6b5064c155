"""Hard negatives against a loop over all pairs, and the bounds of segment summaries."""

import math
import random

import numpy as np
import pytest

from proofgrid.llm import hard_negatives, queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    """The contract's rows (vec_id, embedding, label) by loops."""
    live = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        live.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for anchor, vector, label in live:
        if anchor % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v, strict=False)), i, l) for i, v, l in live if i != anchor)
        for s, positive, _ in [x for x in scored if x[2] == label][:5]:
            fine = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(anchor, positive, k, i, -s, -n) for k, (n, i, _) in enumerate(fine, 1)]
    return sorted(out)


def mined(spark, rows, folder, **sizes):
    path = str(folder / f"t{random.random()}" / "embeddings.parquet")
    wide = [(*r, 1, "x") for r in rows]
    spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int, score int, lane string").write.parquet(path)
    df = queries.op12_hard_negatives(spark, path.rpartition("/")[0])
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def clustered(n, width, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    return [(k, [float(x) for x in 0.6 * centres[k % labels] + 0.5 * rng.normal(size=width)], k % labels) for k in range(n)]


@pytest.mark.parametrize("width,labels", [(64, 10), (5, 3), (1, 2)])
def test_query_against_loops(spark, tmp_path, width, labels):
    rows = clustered(700, width, labels, width)
    want = brute(rows)
    assert want and mined(spark, rows, tmp_path) == want


def test_one_label_holds_most_rows_and_ties(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, [rng.choice((0.5, 1.0)), 1.0, 0.25], 3 if k % 3 else rng.randrange(10)) for k in range(500)]
    want = brute(rows)
    assert want and mined(spark, rows, tmp_path) == want


def test_odd_rows(spark, tmp_path):
    rows = clustered(160, 6, 4, 1)
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (250, [1.0] * 6, None), (300, [1.0, None, 1.0], 1), (350, [float("nan")] * 6, 1), (400, [float("inf")] * 6, 1)]
    rows += [(450, [], 1), (451, [1.0], 1), (452, [0.5] * 9, 2), (50, [0.1] * 6, 2), (50, [0.1] * 6, 2), (51, [0.2] * 6, 3)]
    assert mined(spark, rows, tmp_path) == brute(rows)
    assert mined(spark, [], tmp_path) == []
    assert mined(spark, [(50, [1.0], 1)], tmp_path) == []


def test_small_blocks_agree(spark):
    rows = clustered(900, 16, 5, 2)
    frame = spark.createDataFrame([(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows], "vec_id long, vector array<long>, label int")
    found = lambda **sizes: sorted(map(tuple, hard_negatives.hard_negatives(frame, frame["vec_id"] % 50 == 0, **sizes).collect()))
    assert found() == found(block_rows=17, block_anchors=3) != []


def test_bounds_hold_and_leave_out(spark):
    rng = np.random.default_rng(0)
    centres = rng.integers(-400, 400, (4, 64))
    v = np.array([centres[k % 4] + rng.integers(-60, 60, 64) for k in range(200)])
    w = v.astype("<i8").tobytes(), hard_negatives.summaries(v, 16).astype("<f8").tobytes()
    side = hard_negatives.Side(np.arange(200, dtype="<i8").tobytes(), np.zeros(200, "<i8").tobytes(), *w, 64)
    exact, all_rows = v @ v.T, np.arange(200)
    assert len(side.levels) == 3
    for level in range(3):
        upper = side.upper(level, all_rows) @ side.lower(level, all_rows).T
        lower = side.upper(level, all_rows, -1) @ side.lower(level, all_rows).T
        assert (upper >= exact).all() and (lower <= exact).all()
    low = np.sort(exact, axis=1)[:, -5]
    ai, bi, mask = hard_negatives.candidates(side, side, all_rows, all_rows, low.astype(float))
    assert all(set(np.flatnonzero(exact[a] >= low[a])) <= set(bi[mask[k]]) for k, a in enumerate(ai)) and mask.sum() < 0.8 * mask.size
    assert np.array_equal(hard_negatives.exact(v * 2**26, v), exact * 2**26)


def test_blocks_meet_by_a_shuffle(spark, tmp_path):
    """Files of blocks of equal vectors are tiny, so they were broadcast, a copy for each lane: more than the driver takes."""
    vectors = spark.range(300).selectExpr("id AS vec_id", "id % 3 AS label", "array(1L, 2L, 3L, 4L) AS vector", "id % 10 = 0 AS is_anchor")
    blocks, anchors = hard_negatives.blocked(vectors, 4, 64, 3), hard_negatives.blocked(vectors.where("is_anchor"), 4, 8, 2)
    met = hard_negatives.meetings(anchors, blocks, 2, False)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert met.count() == anchors.count() * blocks.count()


def test_few_pairs_are_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(-400, 400, (60, 8))
    side = hard_negatives.Side(np.arange(60, dtype="<i8").tobytes(), np.zeros(60, "<i8").tobytes(), v.astype("<i8").tobytes(), b"", 8)
    mask, rows = rng.random((60, 60)) < 0.1, np.arange(60)
    monkeypatch.setattr(hard_negatives, "NUMBERS", 20)
    assert np.array_equal(hard_negatives.scored(side, side, rows, rows, mask), np.where(mask, v @ v.T, np.iinfo(np.int64).min))
