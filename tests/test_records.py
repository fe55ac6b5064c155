"""Responses as observations, and rules over records."""

import json

from pyspark.sql import functions as F

from proofgrid.operators import review
from proofgrid.sources import responses


def triples(df):
    return sorted((r["subject"], r["predicate"], r["value"]) for r in df.collect())


def body(spark, target, data):
    return spark.createDataFrame([(target, data if isinstance(data, str) else json.dumps(data)), ("bad", "not json {")], "target string, body string")


def test_dns_and_registration(spark):
    assert triples(responses.dns(body(spark, "example.com", {"rtype": "A", "records": ["93.184.216.34", "ns.example."]}))) == [("example.com", "dns.a", "93.184.216.34"), ("example.com", "dns.a", "ns.example")]
    data = {"entities": [{"roles": ["Registrar"], "handle": "h1", "vcardArray": ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", "Reg Inc"]]]}, {"roles": ["abuse"], "handle": "h2"}], "status": ["ok", "locked"], "events": [{"eventAction": "expiration", "eventDate": "2027"}], "nameservers": [{"ldhName": "a.ns."}]}
    assert triples(responses.registration(body(spark, "d", data))) == [("d", "domain.nameserver", "a.ns"), ("d", "registrar", "Reg Inc"), ("d", "registration.event.expiration", "2027"), ("d", "registration.status", "ok|locked")]


def test_certificates_addresses_archives(spark):
    assert triples(responses.certificate_names(body(spark, "x.org", [{"name_value": "*.A.x.org,x.org"}, {"name_value": "a.x.org"}]))) == [("x.org", "domain.subdomain_seen_in_ct", "a.x.org")]
    got = dict(x[1:] for x in triples(responses.address_facts(body(spark, "1.1.1.1", {"ip": "1.1.1.1", "asn": "AS13", "org": "", "isp": "I", "country_code": "AU", "lat": 1.5, "lng": 2.0}))))
    assert got == {"ip.address": "1.1.1.1", "ip.asn": "AS13", "ip.organization": "I", "ip.country": "AU", "ip.location": "1.5,2.0"}
    assert triples(responses.snapshots(body(spark, "x", [["urlkey", "original", "timestamp"], ["k", "http://x/", "2020"]]))) == [("x", "archive.snapshot", "2020 http://x/")]
    assert ("9.9.9.9", "ptr.hostname", "b.example") in triples(responses.reverse_names(body(spark, "9.9.9.9", "a.example\n b.example \n")))


def test_advisories_chains_feeds(spark):
    got = json.loads(triples(responses.vulnerabilities(body(spark, "p", {"vulns": [{"id": "G1", "aliases": ["X", "CVE-1"], "summary": "s"}]})))[0][2])
    assert got == {"osv_id": "G1", "cve": "CVE-1", "summary": "s"}
    tx = [{"txid": "t", "vin": [{"prevout": {"scriptpubkey_address": "b"}}, {"prevout": {"scriptpubkey_address": "a"}}, {"prevout": None}], "vout": [{"scriptpubkey_address": "c"}, {}]}]
    assert json.loads(triples(responses.transactions(body(spark, "a", tx)))[0][2]) == {"txid": "t", "inputs": ["a", "b"], "outputs": ["c"]}
    feed = "<rss><channel><item><title>T</title><link>http://l</link><pubDate>d</pubDate></item><item><title>U</title></item></channel></rss>"
    assert [json.loads(x[2])["title"] for x in triples(responses.feed_items(body(spark, "f", feed)))] == ["T", "U"]


def test_reviews(spark):
    claims = spark.createDataFrame([(1, "s", "proposed", ["e1", "e2"]), (2, " ", "proposed", ["e1"]), (3, "s", "refuted", ["e1"]), (4, "s", "proposed", None)], "claim_id int, statement string, status string, citations array<string>")
    assert {r["claim_id"]: (r["reason"], r["claim_class"]) for r in review.claim_review(claims).collect()} == {1: (None, "SUPPORTED"), 2: ("empty statement", "PARTIALLY_SUPPORTED"), 3: ("withdrawn", "DISPUTED"), 4: ("no citations", "UNSUPPORTED")}
    hypotheses = spark.createDataFrame([(1, "s", ["f1"], [], ["x"], ["alt"], "t"), (2, "", ["f9"], None, [], None, None)], "hypothesis_id int, statement string, supporting_fact_ids array<string>, opposing_fact_ids array<string>, falsifications array<string>, alternative_explanations array<string>, next_test string")
    got = {r["hypothesis_id"]: len(r["problems"]) for r in review.hypothesis_review(hypotheses, spark.createDataFrame([("f1",)], "fact_id string")).collect()}
    assert got == {1: 0, 2: 5}
    counts = spark.createDataFrame([(1, "a", 3, 0, 1, 0, False), (1, "b", 1, 2, 1, 0, False), (1, "c", 0, 0, 0, 4, False), (1, "d", 1, 0, 0, 0, True), (2, "e", 0, 1, 0, 0, False)], "case_id int, hypothesis_id string, consistent int, inconsistent int, neutral int, unknown int, falsified boolean")
    assert {r["hypothesis_id"]: r["status"] for r in review.recommended_status(counts).collect()} == {"a": "strengthened", "b": "weakened", "c": "inconclusive", "d": "falsified", "e": "weakened"}


def test_grants_access_sources(spark):
    grants = spark.createDataFrame([("g1", ["read"], 100.0, 50.0, False), ("g2", ["read"], 0.0, 50.0, False), ("g3", ["read"], 100.0, 50.0, True)], "grant_id string, allowed_tools array<string>, issued_at double, ttl_seconds double, revoked boolean")
    asked = spark.createDataFrame([(1, "g1", "read"), (2, "g1", "write"), (3, "g2", "read"), (4, "g3", "read"), (5, "nope", "read"), (6, None, "read")], "request_id int, grant_id string, tool string")
    assert {r["request_id"]: r["reason"] for r in review.grant_decisions(asked, grants, 120.0).collect()} == {1: "granted", 2: "tool_not_granted", 3: "grant_expired_or_revoked", 4: "grant_expired_or_revoked", 5: "unknown_grant", 6: "unknown_grant"}
    pairs = spark.createDataFrame([("", "default", True), ("a", "default", False), ("a", "a", True), ("a", "b", False), (None, None, True), (None, "b", False)], "asks string, owner string, fine boolean")
    assert pairs.where(review.tenant_allowed(F.col("asks"), F.col("owner")) != F.col("fine")).collect() == []
    acts = spark.createDataFrame([("x", ["x"], ["x"], False), ("x", ["x"], [], True), ("x", [], [], False), ("x", None, None, False)], "act string, ok array<string>, no array<string>, fine boolean")
    assert acts.where(review.action_allowed(F.col("act"), F.col("ok"), F.col("no")) != F.col("fine")).collect() == []
    sources = spark.createDataFrame([("s1", 1, ["a"]), ("s2", 2, ["a", "b"])], "slug string, order int, capabilities array<string>")
    wanted = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c")], "target string, capability string")
    assert {r["capability"]: r["slug"] for r in review.source_choice(wanted, sources).collect()} == {"a": "s1", "b": "s2", "c": None}
    seen = spark.createDataFrame([(1, "a", "e"), (1, "b", None)], "case_id int, capability string, evidence_id string")
    assert [r["capability"] for r in review.evidence_gaps(spark.createDataFrame([(1, "a"), (1, "b")], "case_id int, capability string"), seen).collect()] == ["b"]
