"""Budgeted traces against the recursive loop."""

import random

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import trace


def loop(edges, start, labels, depth, fan_out, calls):
    near = {}
    for a, b in sorted({(a, b) for a, b in edges if a and b}):
        near.setdefault(a, []).append(b)
    out, used = [], 0

    def go(address, path, level):
        nonlocal used
        if level > depth:
            out.append((path, level, address, "too_deep", None))
        elif address.startswith("bad"):
            out.append((path, level, address, "invalid", None))
        elif address in labels:
            out.append((path, level, address, "boundary", None))
        elif used >= calls:
            out.append((path, level, address, "budget", None))
        else:
            used += 1
            out.append((path, level, address, "visited", used))
            for k, b in enumerate(near.get(address, [])[:fan_out]):
                go(b, f"{path}{k:02d}", level + 1)

    go(start, "", 0)
    return out


@pytest.mark.parametrize("calls", [0, 1, 7, 25])
def test_trace_is_the_loop(spark, calls):
    rng = random.Random(calls)
    names = [f"n{k}" for k in range(25)] + ["bad1", "bad2"]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(140)] + [(None, "n1"), ("n1", None), ("n1", "n2"), ("n1", "n2")]
    labels = {"n3": "exchange", "n4": "pool"}
    starts = ["n0", "n1", "n3", "bad1", "alone", "n0", None]
    frame = spark.createDataFrame([(*e, "x") for e in edges], "source string, target string, path string")
    found = trace.budgeted_trace(frame, spark.createDataFrame([(s,) for s in starts], "start_id string"), spark.createDataFrame(list(labels.items()), "address string, label string"), ~F.col("address").startswith("bad"), 3, 4, calls).collect()
    got = sorted((r["start_id"], r["path"], r["depth"], r["address"], r["outcome"], r["call_no"]) for r in found) if found else []
    want = sorted((s, *row) for s in {*starts} - {None} for row in loop(edges, s, labels, 3, 4, calls))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r["label"] for r in found if r["outcome"] == "boundary"} <= set(labels.values())
