"""License scans of texts in which notices are interrupted, repeated, nested or cut, against brute force."""

import random

import pytest

from proofgrid.llm import license_scan as scan


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_interrupted_notices_are_found():
    foreign = "Licensed under the " + "zz " * 60 + "Apache License, Version 2.0."
    assert scan.Scanner().scan(foreign) == [("Apache-2.0", 1.0, 8, 0, len(foreign) - 1)]
    spread = " ".join(w + " foo bar baz" for w in scan.TEMPLATES["MIT-text"].split())
    (name, coverage, words, first, end), = scan.Scanner().scan(spread)
    assert (name, coverage, first) == ("MIT-text", 1.0, 0) and spread[first:end].split()[-1] == "SOFTWARE"
    prose = " ".join(["of the and to in or a"] * 200)
    body = scan.TEMPLATES["ISC"]
    (name, coverage, *_), = scan.Scanner().scan(f"{prose} {body} {prose}")
    assert (name, coverage) == ("ISC", 1.0)


def test_copies_count_each_and_nested_notices_once():
    both = "\n".join([scan.TEMPLATES["Apache-2.0-header"]] * 3)
    assert [m[0] for m in scan.Scanner().scan(both)] == ["Apache-2.0-header"] * 3
    assert [m[0] for m in scan.Scanner().scan("All rights reserved. " * 4)] == ["all-rights-reserved"] * 4
    assert {m[0] for m in scan.Scanner().scan(scan.TEMPLATES["BSD-2-Clause"])} == {"BSD-2-Clause"}


@pytest.mark.parametrize("seed", range(4))
def test_matches_against_brute_force(seed):
    """A text has a match if and only if some stretch of it has enough of the template, densely enough, by all stretches' subsequences."""
    rng = random.Random(seed)
    for _ in range(60):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))]
        words = [rng.choice("abcdefghxyz") for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(words))
            words[at:at] = [w for w in template for w in ([w, "z"] if rng.random() < 0.3 else [w])][rng.randint(0, 1) :]
        density = rng.choice((0.05, 0.5))
        scanner = scan.Scanner({"t": " ".join(template)}, 0.8, density)
        need = scanner.templates[0].need
        want = any(lcs(template, words[i:j]) >= max(need, density * (j - i)) for i in range(len(words)) for j in range(i + 1, len(words) + 1))
        got = scanner.scan(" ".join(words))
        if density == 0.05:
            assert bool(got) == want, (template, words)
        assert want or not got
        for _, coverage, n, first, end in got:
            inside = " ".join(words)[first:end].split()
            assert need <= n <= lcs(template, inside) and coverage == n / len(template)


def test_very_long_texts_are_scanned_whole():
    rng = random.Random(3)
    stock = [w for body in scan.TEMPLATES.values() for w in scan.words_of(body)] + ["filler"] * 3000
    body = " ".join(rng.choice(stock) for _ in range(60_000))
    found = scan.Scanner().scan(f"{body} {scan.TEMPLATES['Zlib']} {body}")
    assert any(m[0] == "Zlib" and m[1] > 0.95 for m in found)


def test_repeated_and_partial_notices_take_time_in_proportion():
    import time

    for unit in ("All rights reserved. ", "All rights. ", "Permission is hereby granted, free of charge, to any person. ", scan.TEMPLATES["ISC"] + "\n"):
        spent, found = [], []
        for n in (300, 2400):
            text = unit * n
            began = time.process_time()
            found.append(len(scan.Scanner().scan(text)))
            spent.append(time.process_time() - began)
        assert spent[1] < 8 * 3 * spent[0] + 0.5, (unit[:20], spent)
        assert found[1] in (0, 8 * found[0]), unit[:20]
