"""Lines with their places and damage; versions, whole or not at all."""

import json

import pytest
from pyspark.errors import PySparkException

from proofgrid.sources import lines, versions

SCHEMA = "id bigint, n int, name string"


def test_every_line_has_its_place_over_splits(spark, tmp_path):
    texts = {f"part-{f}.txt": [f"{f}:{k}:" + "x" * (k % 50) for k in range(3000)] for f in range(2)}
    for name, rows in texts.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {(r["file"], r["line_no"]): r["line"] for r in lines.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, k): line for name, rows in texts.items() for k, line in enumerate(rows, 1)}


def test_damage_is_told_by_place(spark, tmp_path):
    rows = ['{"id": 1, "n": 1, "name": "a"}', "", '{"id": 2, "n"', "[1]", "7", '{"n": 3}', '{"id": null, "n": 3}', '{"id": 4, "n": "many"}', '{"id": 5}', '{"id": 1, "n": 9, "name": null, "more": {}}', '{"id": 6, "n": 3, "name": "é\\n"}']
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n")
    checked = lines.checked_records(lines.numbered_lines(spark, str(tmp_path)), spark.createDataFrame([], SCHEMA).schema, "id")
    reasons = {r["line_no"]: r["reason"] for r in checked.collect()}
    assert reasons == {1: None, 2: "blank", 3: "not_json", 4: "not_an_object", 5: "not_an_object", 6: "no_key", 7: "no_key", 8: "wrong_type", 9: None, 10: None, 11: None}
    last = sorted(tuple(r) for r in lines.last_records(checked, "id").collect())
    assert last == [(1, 9, None, "a.jsonl", 10), (5, None, None, "a.jsonl", 9), (6, 3, "é\n", "a.jsonl", 11)]
    lost = {r["reason"]: (r["n"], r["first_line"], r["last_line"]) for r in lines.losses(checked).collect()}
    assert lost["not_an_object"] == (2, 4, 5) and lost["no_key"] == (2, 6, 7) and sum(n for n, _, _ in lost.values()) == 7


def test_versions_are_whole_and_written_once(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(LookupError):
        versions.read_version(spark, root)
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k int, kind string")
    made = versions.publish(one, root, 1, "kind", "first")
    assert made["n_rows"] == 3 and made["counts"] == {"a": 1, "b": 2}
    with pytest.raises(versions.VersionTaken):
        versions.publish(one, root, 1)
    broken = one.selectExpr("k", "raise_error('lost') AS kind")
    with pytest.raises(PySparkException):
        versions.publish(broken, root, 2)
    assert versions.read_version(spark, root).count() == 3 and [m["version"] for m in versions.manifests(spark, root)] == [1]
    versions.publish(one.where("k = 2"), root, 2)
    versions.publish(one.where("k > 3"), root, 10)
    assert versions.read_version(spark, root, 2).collect()[0]["k"] == 2 and versions.read_version(spark, root).count() == 0
    assert [json.dumps(m["version"]) for m in versions.manifests(spark, root)] == ["1", "2", "10"]


def test_a_second_writer_at_the_same_time_is_refused(spark, tmp_path, monkeypatch):
    """Both have seen that the version is free; the second to publish is refused and the first one's rows stay."""
    root, one = str(tmp_path / "t"), spark.range(3)
    real = versions._manifest

    class Blind:
        def __init__(self, files):
            self.files = files

        def exists(self, path):
            return False

        def create(self, path, overwrite):
            return self.files.create(path, overwrite)

    versions.publish(one, root, 1)
    monkeypatch.setattr(versions, "_manifest", lambda *a: (Blind(real(*a)[0]), real(*a)[1]))
    with pytest.raises(versions.VersionTaken):
        versions.publish(spark.range(9), root, 1)
    assert versions.read_version(spark, root).count() == 3


def test_missing_rows_are_noticed(spark, tmp_path):
    root = str(tmp_path / "t")
    made = versions.publish(spark.range(100).repartition(2), root, 1)
    next((tmp_path / "t" / made["folder"]).glob("part-*.parquet")).unlink()
    with pytest.raises(RuntimeError, match="has 50 rows, not 100"):
        versions.read_version(spark, root)


def test_snapshots_of_matrices_add_versions(spark, tmp_path):
    from proofgrid.operators import attack

    rows = lambda *versions: spark.createDataFrame([("m", v, f"id{k}") for v in versions for k in range(2)], "matrix string, version string, stix_id string")
    path = str(tmp_path / "s")
    attack.write_snapshot(rows("1.0"), path)
    attack.write_snapshot(rows("2.0", "3.0"), path)
    with pytest.raises(ValueError, match="version 2.0 of m is there"):
        attack.write_snapshot(rows("2.0", "4.0"), path)
    assert attack.read_snapshot(spark, path, rows("1.0").schema).count() == 6
