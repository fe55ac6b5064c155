"""First-come representatives against the plain loop over documents in order."""

import random

from proofgrid.operators import independence

DOCS = "grp string, doc_id long, turn int, sha256 string, source string, publisher string, upstream string, reason string"


def related(a, b, jaccard):
    """The first rule by which two documents depend, or None."""
    (_, i, _, sha_a, src_a, pub_a, up_a), (_, j, _, sha_b, src_b, pub_b, up_b) = a, b
    close = jaccard.get((min(i, j), max(i, j)), 0)
    tests = [sha_a and sha_a == sha_b, up_a and up_a == src_b or up_b and up_b == src_a, up_a and up_a == up_b, close >= 0.85, close >= 0.55, pub_a and pub_a == pub_b]
    return next((k for k, met in enumerate(tests, 1) if met), None)


def loop(docs, jaccard):
    out, clusters = [], {}
    for d in sorted(docs, key=lambda d: (d[2], d[1])):
        heads = clusters.setdefault(d[0], [])
        for head in heads:
            if rule := related(head, d, jaccard):
                out.append((d[0], d[1], head[1], *independence.RULES[rule]))
                break
        else:
            heads.append(d)
            out.append((d[0], d[1], d[1], None, None))
    return sorted(out, key=str)


def found(spark, docs, jaccard):
    similar = spark.createDataFrame([(a, b, j) for (a, b), j in jaccard.items()], "doc_a long, doc_b long, jaccard double")
    rows = independence.independent_clusters(spark.createDataFrame([(*d, "clash") for d in docs], DOCS), similar)
    return sorted((tuple(r) for r in rows.select("grp", "doc_id", "representative", "kind", "reason").collect()), key=str)


def test_a_chain_is_two_clusters(spark):
    docs = [("g", k, k, None, None, None, None) for k in range(3)]
    assert found(spark, docs, {(0, 1): 0.9, (1, 2): 0.9}) == [("g", 0, 0, None, None), ("g", 1, 0, "DEPENDENT", "near-duplicate content"), ("g", 2, 2, None, None)]


def test_random_documents_match_the_loop(spark):
    rng = random.Random(2)
    pick = lambda *options: rng.choice(options)
    docs = [(pick("g", "h", "k", None), k, rng.randrange(40), pick(None, "", *[f"x{i}" for i in range(30)]), f"s{rng.randrange(25)}", pick(None, "", *[f"p{i}" for i in range(25)]), pick(None, None, "", *[f"s{i}" for i in range(25)])) for k in range(160)]
    jaccard = {(a, b): pick(0.3, 0.55, 0.7, 0.85, 1.0) for a, b in {tuple(sorted(rng.sample(range(160), 2))) for _ in range(260)}}
    assert found(spark, docs, jaccard) == loop(docs, jaccard)


def test_nothing_and_one_hot_key(spark):
    assert found(spark, [], {}) == []
    docs = [("g", k, k, "same", None, None, None) for k in range(300)]
    assert found(spark, [*docs, docs[0]], {}) == loop(docs, {})
