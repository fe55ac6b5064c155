"""Patterns by their literals against every pattern on every text."""

import random
import re

import pytest

from proofgrid.operators import patterns

LITERALS = {
    r"powershell\s+-[encw]": ["powershell"], r"scheduled task|schtasks": ["scheduled task", "schtasks"], r"currentversion\\run": ["currentversion\\run"], r"exfiltration over (alt protocol|c2)": ["exfiltration over "],
    r"colou?r": ["colo"], r"ab*cd+e": ["cd"], r"x{2}yz": ["yz"], r"[abc]+": None, r"a|long": None, r"(one|two)": None, r"(?i)abc": None, r"": None, r"\d+ items": [" items"], r"a\.b\.c": ["a.b.c"], r"Über alles": None,
}


@pytest.mark.parametrize("pattern", LITERALS)
def test_required_literals(pattern):
    assert patterns.required_literals(pattern) == LITERALS[pattern]


def test_matches_are_those_of_all_patterns(spark):
    rng = random.Random(1)
    known = [*LITERALS, *[p for p, _, _ in patterns.BEHAVIOURS], r"^alone$", r"e.d", None]
    words = "powershell -enc -x schtasks scheduled task vmware color colour abbcdde xxyz exfiltration over c2 currentversion\\run 12 items a.b.c axbxc one alone long über alles UBER end Mimikatz".split(" ")
    texts = [" ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(150)] + [None, "", "alone"]
    rows = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "text_id int, text string, number string")
    table = spark.createDataFrame(list(enumerate(known)), "pattern_id int, pattern string")
    got = {(r["text_id"], r["pattern_id"]) for r in patterns.matches(rows, table).collect()}
    want = {(k, i) for k, t in enumerate(texts) for i, p in enumerate(known) if p is not None and re.search(p, t or "", re.I | re.A)}
    assert got == want and len(want) > 100
    assert patterns.matches(rows, table.limit(0)).collect() == [] and patterns.matches(rows.limit(0), table).collect() == []
