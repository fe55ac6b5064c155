"""Fingerprints, classifier, WARC, license scans, token files, extraction and packing against brute force and round trips."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from proofgrid.llm import fingerprints, html_extract, license_scan, packing, quality, token_store, tokens, warc
from proofgrid.llm.common import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, key string, ids string, row long"
ODD = [(3, "c d e", "en", "s", 5, "x", "x", "x", 1), (1, None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", "x", "x", 1), (None, "null id", "en", "s", 7, "x", "x", "x", 1), (3, "c d e", "en", "s", 5, "x", "x", "x", 1), (7, "lang 'tis <|endoftext|> Ünï " * 3000, "en", "s", 9, "x", "x", "x", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def text(rng, n, stock=300):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def test_word_hashes_do_not_depend_on_pieces():
    body = "ab cd\tef\n" * 50 + "x" * 300 + " yz"
    whole = word_hashes(body)
    assert len(whole) == len(body.split()) and (whole == word_hashes(body, 64)).all() and (whole == word_hashes(body, 7)).all()
    assert len(set(whole.tolist())) == len(set(body.split()))


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3, text(rng, rng.choice([0, 1, 3, 60, 400]))) for i in range(60)]
    got = {r["doc_id"]: r for r in fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for k, (i, body) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(body) // 4
        changed = body[: len(body) - n] + after[:n]
        r = got[i]
        assert r["n_chars"] == len(body) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(body) and r["edited_fingerprint"] == fingerprints.fingerprint(changed)
        a, b = set(shingle_hashes(word_hashes(body)).tolist()), set(shingle_hashes(word_hashes(changed)).tolist())
        exact = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - exact) < 0.12
        c = set(shingle_hashes(word_hashes(after)).tolist())
        assert abs(r["near_next"] - (len(a & c) / len(a | c) if a | c else 1.0)) < 0.12


def test_fingerprints_of_odd_rows(odd):
    got = fingerprints.document_fingerprints(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ODD)
    assert fingerprints.document_fingerprints(odd.limit(0)).collect() == []
    one = fingerprints.document_fingerprints(odd.where("doc_id = 2")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["fingerprint"] == ""


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.3
        words = [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" + ("%%%" if bad and rng.random() < 0.5 else "") for _ in range(40)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    labels += [(None, 1), (5, None)]
    got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) / len(held) > 0.95


def test_classifier_without_labels_and_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(odd, none).collect()
    assert [r["score"] for r in got] == [0.5] * len(ODD)
    assert quality.score_quality(odd.limit(0), none).collect() == []


def test_features_do_not_depend_on_pieces():
    body = "Some words, and *** signs é%% " * 40
    whole, parts = (Counter(np.concatenate(list(quality.ngram_hashes(body, piece))).tolist()) for piece in (1 << 20, 50))
    assert whole == parts


def test_warc_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 5}.example/ä b\r\n{i}", f"<p>{text(rng, 50)}</p>") for i in range(300)] + [(900, None, None), (901, "http://x", ""), (5, "again", "dup"), (4000, "u", "dup"), (None, "u", "dup"), (None, "u", "nul")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=4000)).collect()
    assert len(got) == len(rows)
    html = lambda r: (r[2] or "").encode()
    want = []
    for r in rows:
        first = min((x[0] for x in rows if html(x) == html(r) and x[0] is not None), default=None)
        again = r[0] != first
        want.append((r[0], r[1], len(html(r)), base64.b32encode(hashlib.sha1(html(r)).digest()).decode(), "revisit" if again else "response", first if again else None, None if again else html(r)))
    assert sorted(map(str, (tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got))) == sorted(map(str, want))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []
    small = warc.read_archives(warc.write_archives(pages, min_bytes=4), payloads=False).collect()
    assert all(r["record_type"] == "response" for r in small)


def test_warc_reader_refuses_damage():
    import struct

    import zstandard

    row = {"page_id": 1, "url": "u", "payload": b"hello", "sha1": hashlib.sha1(b"hello").hexdigest(), "refers_to": None}
    record = warc.record_bytes(row)
    dictionary = zstandard.ZstdCompressionDict(b"WARC/1.1 response " * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = lambda r: zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True).compress(r)
    head = struct.pack("<II", warc.SKIPPABLE, len(dictionary.as_bytes())) + dictionary.as_bytes()
    whole = head + pack(record) + pack(record)
    assert len(list(warc.records_of(whole))) == 2
    for bad in (whole[:-3], whole + b"xx", head + pack(record.replace(b"Content-Length: ", b"Content-Length: 1")), head + pack(b"HTTP" + record[4:]), head + pack(record.replace(b"WARC-Date", b"WARC-Dat0"))):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))
    with pytest.raises(ValueError):
        warc.page_of(*next(warc.records_of(head + pack(record.replace(b"hello", b"hallo")))))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_patience_pairs_are_an_alignment():
    rng = random.Random(6)
    for _ in range(200):
        a, b = [[rng.randrange(12) for _ in range(rng.randrange(25))] for _ in range(2)]
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= lcs(a, b)
        assert license_scan.patience(a, a) == [(i, i) for i in range(len(a))]


def test_license_scan_finds_planted_notices(spark, odd):
    rng = random.Random(8)
    notices = license_scan.TEMPLATES
    rows, want = [], {}
    for i, name in enumerate(n for n in notices for _ in range(4)):
        words = notices[name].split()
        if len(words) >= 10:
            words[rng.randrange(1, len(words))] = "changed"  # the first word is asked for below
        rows.append((i, text(rng, 200) + " " + " ".join(words) + ("\n" + notices[name]) * (i % 2) + " " + text(rng, 100)))
        want[i] = (name, 1 + i % 2)
    rows.append((1000, text(rng, 500) + " license the software of rights"))
    got = {r["doc_id"]: r for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, n) in want.items():
        found = license_scan.Scanner({name: notices[name]}).scan(rows[i][1])
        assert len(found) == n and name in got[i]["templates"].split(","), (name, rows[i][1])
        assert rows[i][1][found[0][3] : found[0][4]].split()[0].lower().strip("\"'(") == notices[name].split()[0].lower()
    assert got[1000]["n_matches"] == 0
    assert len(license_scan.license_report(odd).collect()) == len(ODD) and license_scan.license_report(odd.limit(0)).collect() == []
    assert len(license_scan.license_matches(odd).collect()) == len(ODD)


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 31])
def test_packed_ids_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    data = token_store.pack(ids, bits)
    assert len(data) == (1000 * bits + 7) // 8 and (token_store.unpack(data, bits, 1000) == ids).all()
    with pytest.raises(ValueError):
        token_store.pack(np.array([1 << bits], np.uint32), bits)


def test_word_tokenizer_equals_the_library():
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    mine = tokens.WordTokenizer(most=50)
    rng = random.Random(9)
    signs = ["'s", "don't", "É", "é", "ΑΣ", "İstanbul", "<|endoftext|>", "<|ENDOFTEXT|>", "***", "x.y,z", "12a", " ", "​", "𝔘", "ﬁ", "́", "\x1c", " "]
    for n in range(150):
        body = "".join(rng.choice(signs + list("abcXYZ .,\n\t") + ["the ", "word "]) for _ in range(rng.randrange(60)))
        assert mine.encode(body).tolist() == [*plain.encode(body, add_special_tokens=False).ids, 2], repr(body)


def by_id(body):
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER)).encode(body or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd):
    rng = random.Random(10)
    rows = [(i, text(rng, rng.choice([0, 5, 3000]))) for i in rng.sample(range(1000), 40)]
    back = token_store.read_tokens(token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), block=64), ids=True)
    got, at = {r["doc_id"]: r for r in back.collect()}, 0
    for i, body in sorted(rows):
        ids = by_id(body)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], list(got[i]["ids"])) == (at, len(ids), crc(ids), ids)
        at += len(ids)
    got = token_store.read_tokens(token_store.write_tokens(odd)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 7] and got[1]["n_tokens"] == 1
    assert token_store.read_tokens(token_store.write_tokens(odd.limit(0))).collect() == []


def test_packing_holds_each_id_once(spark, odd):
    rng = random.Random(11)
    rows = [(i, text(rng, rng.choice([0, 1, 40, 200, 900, 6000]))) for i in range(150)]
    for docs, source in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, ODD)):
        pieces = packing.pack_documents(docs).collect()
        ids = Counter((r[0], tuple(by_id(r[1]))) for r in source)
        at, seen = {}, Counter()
        for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
            assert p["offset"] == at.get(p["sequence_id"], 0)
            at[p["sequence_id"]] = p["offset"] + p["length"]
            seen[p["doc_id"]] += p["length"]
        for doc in {d for d, _ in ids}:
            assert seen[doc] == sum(len(x) * n for (d, x), n in ids.items() if d == doc)
        assert sum(n <= 4096 and n & (n - 1) != 0 for n in at.values()) == 0 and max(at.values()) <= 4096
        lookup = {}
        for d, x in ids:
            lookup.setdefault(d, []).append(x)
        for p in pieces:
            assert any(len(x) == p["doc_tokens"] and crc(x[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for x in lookup[p["doc_id"]])
    assert packing.pack_documents(odd.limit(0)).collect() == []


def test_nnls_and_recipes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, x = rng.random((12, 30)), np.maximum(rng.normal(size=30), 0)
        b = a @ x
        got = packing.nnls(a, b)
        assert (got >= 0).all() and np.linalg.norm(a @ got - b) < 1e-6 * np.linalg.norm(b)
    table = packing.combinations()
    assert (table @ np.arange(1, 64) == 64).all() and len({tuple(r) for r in table.tolist()}) == len(table) and table.sum(axis=1).max() == packing.DEPTH
    histogram = rng.integers(0, 1000, 63)
    used, times = packing.recipes(histogram)
    assert (times @ used <= histogram).all() and (times @ used) @ np.arange(1, 64) > 0.6 * histogram @ np.arange(1, 64)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no</article>";</script></head><body class="home"><header><a href="/">Site</a></header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="wrap"><div class="post-{n} content"><h1>Head &amp; line</h1>
<p>First   para<b>graph</b>&nbsp;one.<br>Still &lt;one&gt; &eacute;.<p>Second one <a href="y">with link</a> and more words in it.</p><div class="ad banner">Buy now</div><aside>Side</aside><form><input><button>Go</button></form>
<ul><li>item a<li>item b</ul><div class="comments"><p>Nice post, says a reader with a long long long comment text here</p></div></div><div class="sidebar"><p>Other posts</p></div></div><footer>&copy; x</footer>"""


def test_html_extraction(spark):
    want = "Head & line\nFirst paragraph one. Still <one> é.\nSecond one with link and more words in it.\nitem a\nitem b"
    pages = [(i, f"http://Host.example:80/{i}", PAGE.replace("{n}", str(i)) + "</body></html>" * (i % 2)) for i in range(6)]
    # a page where a longer notice sits in another container: the host's consensus decides
    pages.append((6, "http://host.example/q", PAGE.replace("{n}", "6").replace("<p>Other posts</p>", "") + "<div class='x'>" + "<p>Legal words of no interest at all.</p>" * 30 + "</div>"))
    pages += [(7, "http://other.example/", "<p>plain <b>text"), (8, None, None), (9, "", ""), (10, "http://bad.example/", "<div <p>> <<a href='x\"> open < 3 & 4 > 2 &bogus; text</a"), (None, "http://host.example/", PAGE)]
    got = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    for i in [*range(7), None]:
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert got[7]["text"] in ("", "plain text") and got[8]["text"] == got[9]["text"] == ""
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
