"""Queries whose work is to grow no faster than their tables."""

import time

import __spark_entry__ as entry
import numpy as np
from pyspark.sql import functions as F

from proofgrid.functions.text import in_span, normalised
from proofgrid.operators import attack, cases, documents, entities, graph, independence, rules, trace

SOURCES = "slug string, `order` long, capabilities array<string>, qualification string, wired boolean"


def test_readiness_meets_sums_of_sources(spark):
    levels = rules.QUALIFICATIONS
    offers = [(f"s{k}", k, ["a", "b"], levels[k % 3], k % 2 == 1) for k in range(400)] + [("odd", -1, ["a"], "unheard_of", True), ("none", -2, None, levels[3], True), ("nil", None, ["c"], levels[3], True)]
    sources = spark.createDataFrame(offers, SOURCES)
    assert rules.qualified(sources).count() == 3 + 3 + 4  # sources of two capabilities reach three levels, one of the third all four
    asked = [(1, "a", True, levels[2]), (1, "a", True, levels[3]), (2, "b", False, levels[3]), (3, "c", True, levels[0]), (4, "a", True, None), (5, "x", True, levels[0])]
    got = rules.readiness(spark.createDataFrame(asked, "module_id long, capability string, required boolean, least string"), sources).collect()
    none = (False, "no source qualifies", None)
    want = [(1, "a", True, "", "s5"), (1, "a", *none), (2, "b", True, "", None), (3, "c", True, "", None), (4, "a", *none), (5, "x", *none)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pairs_of_one_block_are_dealt_over_tasks(spark):
    rows = spark.createDataFrame([(k, "person", f"n{k % 3}", 1, "x", "DE") for k in range(60)], "id long, kind string, name string, n_evidence int, block string, country string")
    pairs = entities.matched_pairs(rows, ["block"], ["country"]).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r["left_id"], r["right_id"]) for r in pairs}) == len(pairs) == 60 * 59 // 2
    assert len({r["task"] for r in pairs}) > 1


def test_a_wave_carries_only_what_waits_for_it(spark, monkeypatch):
    """A chain of 12 waves beside 500 tasks that wait for its end: they are written with the tables and with their own wave."""
    kept, hold = [], graph.held
    monkeypatch.setattr(graph, "held", lambda df: kept.append(hold(df)) or kept[-1])
    tasks = spark.createDataFrame([(k,) for k in range(512)], "task_id long")
    depends = spark.createDataFrame([(k, k - 1) for k in range(1, 12)] + [(k, 11) for k in range(12, 510)] + [(510, 511), (511, 510), (510, 0)], "task_id long, depends_on long")
    got = {r["task_id"]: r["wave"] for r in graph.waves(tasks, depends).collect()}
    assert got == {k: k if k < 12 else 12 for k in range(510)} | {510: None, 511: None}
    assert sum(df.count() for df in kept) < 5 * 512
    assert {r["task_id"] for r in graph.cyclic(tasks, depends).collect()} == {510, 511}


def test_edges_are_moved_once_before_they_go_both_ways(spark):
    edges = spark.createDataFrame([(f"a{k % 50}", f"b{k % 30}") for k in range(400)] + [("b1", "a1"), ("c", "c"), (None, "a1"), ("a1", None)], "source string, target string")
    both = graph.undirected(edges)
    want = {(a, b) for k in range(400) for a, b in ((f"a{k % 50}", f"b{k % 30}"), (f"b{k % 30}", f"a{k % 50}"))}
    assert sorted(map(tuple, both.collect())) == sorted(want)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Union" not in plan


def test_lines_are_moved_with_numbers(spark):
    """Names of ends are no join keys, so no row of a line is shuffled with them."""
    plan = entry.queries()["relation_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 2 and all("source" not in line.split("Join ")[1] and "target" not in line.split("Join ")[1] for line in joins)


def test_a_round_reads_only_undecided_keys(spark, monkeypatch):
    """One publisher's 300 documents are decided in the first round; a chain of upstreams goes on."""
    kept, hold = [], independence.held
    monkeypatch.setattr(independence, "held", lambda df: kept.append(hold(df)) or kept[-1])
    rows = [("g", k, k, None, None, "p", None) for k in range(300)] + [("g", 1000 + k, 1000 + k, None, f"s{k}", None, f"s{k - 1}") for k in range(6)]
    docs = spark.createDataFrame(rows, "grp string, doc_id long, turn long, sha256 string, source string, publisher string, upstream string")
    got = {r["doc_id"]: r["representative"] for r in independence.independent_clusters(docs).collect()}
    assert got == {k: 0 for k in range(300)} | {1000 + k: 1000 + k - k % 2 for k in range(6)}
    live = [df.count() for df in kept if "key" in df.columns]
    assert len(live) == 3 and live[1] < 20 and live[2] < live[1]


def test_a_pair_at_the_threshold_is_met(spark):
    """0.55 * 100 is a little more than 55 in floats."""
    sets = spark.createDataFrame([(1, list(range(100))), (2, list(range(45, 100)))], "doc_id long, items array<long>")
    assert [tuple(r) for r in documents.similar_pairs(sets, 0.55).collect()] == [(1, 2, 0.55)]


def test_texts_are_normalised_once(spark):
    plan = documents.texts(spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, None)], "doc_id long, text string"))
    assert sorted(map(tuple, plan.collect())) == [(1, "a b", 1), (2, "a b", 1), (3, "", 3)]
    assert "regexp_replace" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_shingles_of_one_text_alone_are_not_ranked(spark):
    """The join of shingles back to their texts carried those of one text alone, too; now the plan has one exchange by shingle and one by text before it holds the prefixes."""
    calls, hold = [], documents.held
    documents.held = lambda df: calls.append(df._jdf.queryExecution().optimizedPlan().toString()) or hold(df)
    try:
        sets = spark.createDataFrame([(k, list(range(k, k + 30))) for k in range(8)], "doc_id long, items array<long>")
        assert documents.similar_pairs(sets, 0.85).count() == 7 + 6
    finally:
        documents.held = hold
    assert "Join" not in calls[0] and "(df" in calls[0]


def test_normalised_is_as_before(spark):
    odd = ["", None, " a  b ", "X?utm_source=q&ref=1 referrer=z ref= utm_=1", "Ünï — ref=a&b\u212a", "utm_a=1utm_b=2 c", "reference=1 prefref=x\ty"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    low = F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), r"(utm_[a-z]+=[^&\s]+|ref(errer)?=[^&\s]+)", "")
    want = F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9 ]+", " "), " +", " "))
    assert all(a == b for a, b in rows.select(normalised(F.col("t")), want).collect())


def test_spans_are_counted_by_runs(spark):
    odd = spark.createDataFrame([("Ünï код αβ 中文 𠀀 ا",), ("",), ("plain words of the text",)], "t string")
    for span in ("A-Za-zÀ-ſ", "Ѐ-ӿ", "Ͱ-Ͽ", "一-鿿", "؀-ۿ"):
        want = F.length(F.regexp_replace("t", f"[^{span}]", ""))
        assert all(a == b for a, b in odd.select(in_span(F.col("t"), span), want).collect())
    for name in ("language_id", "script_counts"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "[^Ѐ-ӿ]+" in plan and "[^Ѐ-ӿ]," not in plan


def test_sides_are_compared_by_numbers(spark):
    rows = [(1, "p", "T1.001", None), (1, "q", "T1.001", "TA1"), (2, "q", "T1", "TA1"), (2, None, "T2", None), (3, None, "T2", None), (3, "p", None, "TA1")]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 3)], "id_a long, id_b long")
    found = attack.compared(spark.createDataFrame(rows, "malware_id long, procedure string, technique_id string, tactic_id string"), pairs)
    want = [(1, 2, "subtechnique", "T1.001", "a", False), (1, 2, "technique", "T1", "common", True), (1, 2, "technique", "T2", "b", False), (1, 2, "tactic", "TA1", "common", False), (2, 3, "technique", "T1", "a", False), (2, 3, "technique", "T2", "common", False), (2, 3, "tactic", "TA1", "common", False), (3, 4, "technique", "T2", "a", False), (3, 4, "tactic", "TA1", "a", False)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "decimal" not in plan


def test_a_trace_keeps_no_more_steps_than_calls(spark, monkeypatch):
    kept, hold = [], trace.held
    monkeypatch.setattr(trace, "held", lambda df: kept.append(hold(df)) or kept[-1])
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(12) for b in range(12)], "source string, target string")
    found = trace.budgeted_trace(edges, spark.createDataFrame([("n1",), ("n2",)], "start_id string"), spark.createDataFrame([], "address string, label string"), calls=5).collect()
    assert len(found) == 2 * (1 + 5 * 10)
    assert all(df.count() <= 2 * 5 for df in kept if "path" in df.columns)


def test_requests_are_moved_without_signals(spark):
    rows = [(1, 7, 1, "CLAIMED_IDENTITY", ["same_wallet"], 1, 0), (2, 7, 2, "CANDIDATE_ASSOCIATION", ["same_wallet", "shared_ip"], 1, 0), (3, 7, 3, "CORROBORATED_ATTRIBUTION", ["same_wallet"], 1, 1), (4, 7, 4, "CORROBORATED_ATTRIBUTION", ["same_wallet"], 1, 2), (5, 8, 5, "CANDIDATE_ASSOCIATION", ["x"], 1, 0), (6, 8, 6, "odd", ["x"], 1, 0), (7, None, 7, "CLAIMED_IDENTITY", ["x"], 1, 0), (8, 8, 8, "CLAIMED_IDENTITY", ["shared_ip"], 1, 0), (9, 8, 9, "CLAIMED_IDENTITY", ["x"], 0, 0)]
    found = cases.promotions(spark.createDataFrame(rows, "request_id long, lead_id long, seq long, target string, signals array<string>, n_evidence int, n_independent int"))
    want = {1: "promoted", 2: "promoted", 3: "corroboration_requires_2_independent_sources", 4: "promoted", 5: "cannot_skip_ladder_rungs", 6: "unknown_level", 8: "non_discriminating_signal_only", 9: "abstain_no_evidence"}
    assert {r["request_id"]: r["reason"] for r in found.collect()} == want and [r["request_id"] for r in found.where("limited").collect()] == [2]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 7


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_what_is_held_leaves_no_shuffle_files(spark):
    """The plan had been made before the setting, so the files stayed as long as the driver's objects."""
    before = shuffle_files(spark)
    assert len(graph.held(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).collect()) == 7
    for _ in range(50):  # they are removed in the background
        if not (made := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not made


def test_hops_are_walked_over_numbers(spark, monkeypatch, tmp_path):
    kept, store = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, *a: kept.append(df.dtypes) or store(df, *a))
    monkeypatch.setattr(graph, "FEW", 1)
    spark.createDataFrame([(-3,), (5,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(7, -9), (8, -9), (9, 1), (None, 1), (10, None)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(7, -3), (7, 5), (8, 6), (9, 4), (None, 6), (8, None), (10, 4)], "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["dst"]: r["n_hops"] for r in entry.queries()["shortest_path"](spark, str(tmp_path)).collect() if r["src"] == "supplier:-3"}
    assert got == {"supplier:-3": 0, "order:7": 1, "supplier:5": 2, "customer:-9": 2, "order:8": 3, "supplier:6": 4}
    assert kept and all(kind != "string" for columns in kept for _, kind in columns)


def near_sets(groups, copies, seed):
    rng = np.random.default_rng(seed)
    for g in range(groups):
        base = rng.integers(-(1 << 62), 1 << 62, 40)
        for _ in range(copies):
            yield np.where(rng.random(40) < 0.15, rng.integers(-(1 << 62), 1 << 62, 40), base)[: int(rng.integers(25, 41))].tolist()


def all_pairs(rows, threshold):
    sets = {k: set(v) for k, v in rows}
    scores = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x | y}
    return {pair: score for pair, score in scores.items() if score >= threshold}


def test_sets_are_moved_for_blocks_not_for_pairs(spark, monkeypatch):
    """Each candidate pair took both sets through two shuffles."""
    monkeypatch.setattr(documents, "WEIGHT", 1200)  # groups are more than one block
    rows = list(enumerate(near_sets(6, 24, 1))) + [(1000, []), (1001, [5]), (1002, [5])]
    found = documents.similar_pairs(spark.createDataFrame(rows, "doc_id long, items array<long>"), 0.55)
    want = all_pairs(rows, 0.55)
    assert {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in found.collect()} == want and len(want) > 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "array_intersect" not in plan


def test_items_that_share_a_code_lose_no_pair(spark):
    """Hashes that differ in their last 26 bits count as one item when candidates are sought, not in the result."""

    def unmixed(x):
        for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9)):
            x ^= x >> shift ^ x >> 2 * shift
            x = x * pow(factor, -1, 1 << 64) % (1 << 64)
        x ^= x >> 30 ^ x >> 60
        return x - (1 << 64) if x >> 63 else x

    item = lambda code, k: unmixed((code * 0x9E3779B97F4A7C15 % (1 << 38)) << 26 | k)
    rows = [(1, [item(c, k) for c in range(20) for k in range(3)]), (2, [item(c, k) for c in range(20) for k in range(1, 4)]), (3, [item(c, 0) for c in range(20)]), (4, [item(c, 9) for c in range(20)]), (5, [item(c, k) for c in range(9, 20) for k in range(3)])]
    sets = spark.createDataFrame(rows, "doc_id long, items array<long>")
    assert documents.packed_items(sets, 0.5, 64).selectExpr("sum(aggregate(lost, 0, (a, x) -> a + x))").first()[0] == 40 + 40 + 22
    found = documents.similar_pairs(sets, 0.5)
    assert {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in found.collect()} == all_pairs(rows, 0.5) == {(1, 2): 0.5, (1, 5): 0.55}


def test_common_items_are_counted_in_packed_rows(spark):
    """A row for each item and document was moved to count how many have the item."""
    rows = list(enumerate(near_sets(3, 50, 2)))
    packed = documents.packed_items(spark.createDataFrame(rows, "doc_id long, items array<long>").coalesce(1), 0.55, 64)
    assert packed.count() <= 65 and packed.selectExpr("sum(octet_length(codes))").first()[0] == 4 * sum(len(v) for _, v in rows)


def test_rounds_are_kept_as_tables(spark, monkeypatch):
    """Keys of pairs were written uncompressed, once more in every round."""
    kept, hold = [], independence.held
    monkeypatch.setattr(independence, "held", lambda df: kept.append(hold(df)) or kept[-1])
    rows = [("g", k, k, None, None, None, None) for k in range(9)]
    docs = spark.createDataFrame(rows, "grp string, doc_id long, turn long, sha256 string, source string, publisher string, upstream string")
    similar = spark.createDataFrame([(k, k + 1, 0.6 + 0.3 * (k % 2)) for k in range(8)], "doc_a long, doc_b long, jaccard double")
    got = {r["doc_id"]: (r["representative"], r["reason"]) for r in independence.independent_clusters(docs, similar).collect()}
    assert got == {k: (k, None) if k % 2 == 0 else (k - 1, "heavy overlap") for k in range(9)}
    assert kept and all(df.inputFiles() and all(f.endswith(".parquet") for f in df.inputFiles()) for df in kept)
