"""The ring of outages over batches, a restart, late rows and closing."""

import datetime as dt

from proofgrid.streaming import outages

POLLS = "feed string, at timestamp, ok boolean, error string"


def at(hour):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=hour)


def test_ring_over_batches_and_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(name, rows):
        spark.createDataFrame(rows, POLLS).coalesce(1).write.parquet(f"{source}/{name}")

    def go():
        stream = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", "1").parquet(f"{source}/*")
        return {r["feed"]: r for r in outages.run(outages.outage_log(stream, kept=3, late="1 hour", forget_ms=100 * 3_600_000), out, state).collect()}

    arrive("a", [("x", at(k), False, f"e{k}") for k in range(2, 6)] + [("x", at(9), True, "fine"), (None, at(1), False, "?"), ("x", None, False, "?"), ("y", at(1), None, None)])
    first = go()
    assert (first["x"]["n_outages"], first["x"]["n_kept"], first["x"]["errors"]) == (4, 3, "e3,e4,e5") and first["y"]["errors"] == "" and set(first) == {"x", "y"}
    arrive("b", [("x", at(4.5), False, "late"), ("x", at(0), False, "beyond the watermark")])
    second = go()
    assert (second["x"]["n_outages"], second["x"]["errors"], second["x"]["first_at"]) == (5, "e4,late,e5", at(2)) and second["y"]["n_outages"] == 1
    arrive("c", [("z", at(500), False, "far")])
    arrive("d", [("z", at(501), False, "far")])
    third = go()
    assert third["z"]["n_outages"] == 2 and not third["z"]["closed"] and third["x"]["closed"] and third["y"]["closed"] and third["x"]["n_outages"] == 5


def test_feeds_share_lanes(spark, tmp_path):
    """The state store has a row for a lane, not for a feed; feeds of a lane are counted and closed each by itself."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(name, rows):
        spark.createDataFrame(rows, POLLS).coalesce(1).write.parquet(f"{source}/{name}")

    def go():
        stream = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", "1").parquet(f"{source}/*")
        return {r["feed"]: r for r in outages.run(outages.outage_log(stream, kept=2, late="1 hour", forget_ms=100 * 3_600_000, lanes=3), out, state).collect()}

    arrive("a", [(f"f{k}", at(k + h), False, f"e{h}") for k in range(40) for h in range(3)])
    first = go()
    assert len(first) == 40 and all((r["n_outages"], r["n_kept"], r["errors"], r["first_at"], r["closed"]) == (3, 2, "e1,e2", at(int(f[1:])), False) for f, r in first.items())
    assert spark.read.format("statestore").load(state).count() == 3
    arrive("b", [("far", at(125.5), False, "far"), ("f30", at(124), False, "again")])
    arrive("c", [("far", at(126), False, "far")])
    second = go()
    # the watermark is 124.5 hours when c comes: feeds with a last outage before 24.5 are closed
    assert {f for f, r in second.items() if r["closed"]} == {f"f{k}" for k in range(23)}
    assert (second["f30"]["n_outages"], second["f30"]["errors"], second["far"]["n_outages"]) == (4, "e2,again", 2)
