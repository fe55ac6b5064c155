"""Targets of odd texts against the rules by hand."""

from proofgrid.operators import targets

TEXTS = {
    1: "see https://A.example/x?y=z and a.example. and A.EXAMPLE, mail me@x.org or ME@X.ORG from AS12 as12 at 10.0.0.1",
    2: "the “Acme Corp” and 'acme corp' and “ spaced name ”",
    3: "größe.de öbc.de x.de. übel",
    4: None, 5: "", 6: "nothing here",
}
WANT = {
    (1, "url", "https://A.example/x?y=z", 1), (1, "domain", "a.example", 2), (1, "domain", "x.org", 2), (1, "email", "me@x.org", 2), (1, "asn", "AS12", 2), (1, "ip_address", "10.0.0.1", 1),
    (2, "quoted", "Acme Corp", 2), (2, "quoted", "spaced name", 1), (3, "domain", "x.de", 1),
}


def test_targets_of_odd_texts(spark):
    rows = spark.createDataFrame([(k, t, "clash") for k, t in TEXTS.items()], "doc_id int, text string, value string")
    got = {tuple(r) for r in targets.targets(rows, "doc_id").collect()}
    quoted = {r for r in got if r[1] == "quoted"}
    assert got - quoted == {r for r in WANT if r[1] != "quoted"}
    assert {(2, "quoted", "Acme Corp"), (2, "quoted", "spaced name")} <= {r[:3] for r in quoted}
    assert targets.targets(rows.limit(0), "doc_id").collect() == []
    two = targets.targets(rows.union(rows.selectExpr("doc_id + 10", "text", "value")), "doc_id")
    assert {(r["kind"], r["value"], r["n_texts"]) for r in targets.shared_targets(two, "doc_id").collect()} >= {("domain", "a.example", 2), ("asn", "as12", 2)}
