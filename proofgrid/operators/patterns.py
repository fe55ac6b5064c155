"""Many patterns over many texts: an index of the literals that patterns require says which texts they can match.

Every alternative of a pattern has to hold some literal text; its longest one is its key. One pass over a text with all keys
(an Aho-Corasick automaton in Arrow batches, built from the patterns once in a worker) finds the patterns that can match it;
only those are run, by Spark. A pattern with an alternative without such a literal is run on all texts. Patterns are few
enough to come to the texts by broadcast up to MOST_PATTERNS, and are shuffled to them beyond that.

Nulls, ties and odd input: a null or empty text matches nothing but patterns that match the empty text; null patterns match
nothing; equal patterns of different ids are patterns of their own; repeated rows are matched each; letters' case doesn't
count; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import held

#: Patterns that are broadcast at most.
MOST_PATTERNS = 20_000
# What hints at a technique, with the technique (none for some) and the tactic.
BEHAVIOURS = (
    (r"powershell\s+-[encw]", "T1059.001", "execution"),
    (r"scheduled task|schtasks", "T1053.005", "persistence"),
    (r"currentversion\\run", "T1547.001", "persistence"),
    (r"lsass|mimikatz|credential dump", "T1003.001", "credential_access"),
    (r"create mutex|openmutex", "", "defense_evasion"),
    (r"http post beacon|beacon interval", "T1071", "command_and_control"),
    (r"virtual machine check|vmware|vbox|qemu detection", "T1497.001", "defense_evasion"),
    (r"file encryption|encrypt files with ransom note", "T1486", "impact"),
    (r"browser cookie theft|steal cookies", "T1539", "credential_access"),
    (r"arp scan|network discovery", "T1018", "discovery"),
    (r"process injection|createremotethread", "T1055", "defense_evasion"),
    (r"exfiltration over (alt protocol|c2)", "T1048", "exfiltration"),
    (r"disable windows defender|amsi bypass|etw bypass", "T1562", "defense_evasion"),
)


def required_literals(pattern: str) -> list[str] | None:
    """For each alternative of a pattern its longest run of plain characters, in lower case; None if one has no run of two or more, or none is safe to name."""
    alternatives, runs, run, depth, at = [], [], "", 0, 0

    def end_run():
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while at < len(pattern):
        c, following = pattern[at], pattern[at + 1 : at + 2]
        if c == "\\":
            if following.isalnum() or not following:
                end_run()
            elif not depth:
                run += following
            at += 2
        elif c == "[":
            end_run()
            at += 2 if following == "]" else 3 if pattern[at + 1 : at + 3] == "^]" else 1
            while at < len(pattern) and pattern[at] != "]":
                at += 2 if pattern[at] == "\\" else 1
            at += 1
        elif c in "()":
            if c == "(" and following == "?":
                return None
            end_run()
            depth += 1 if c == "(" else -1
            at += 1
        elif c == "|":
            end_run()
            if not depth:
                alternatives.append(runs)
                runs = []
            at += 1
        elif c in "*?{+":
            # what is repeated, or may be missing, isn't required with what stands before it
            run = run[:-1] if c != "+" else run
            end_run()
            if c == "{":
                at = pattern.find("}", at)
                if at < 0:
                    return None
            at += 1
        elif c in ".^$":
            end_run()
            at += 1
        else:
            if not depth:
                run += c
            at += 1
    end_run()
    best = [max(r, key=len, default="").lower() for r in [*alternatives, runs]]
    return best if all(len(x) > 1 and x.isascii() for x in best) else None


def candidates(texts: DataFrame, patterns: list[tuple[int, list[str] | None]]) -> DataFrame:
    """texts with number: of each pattern (its number and literals) that its text can match."""

    def find(given):
        import ahocorasick
        import pyarrow as pa

        of_literal: dict[str, list[int]] = {}
        always = [k for k, literals in patterns if literals is None]
        for k, literals in patterns:
            for x in set(literals or ()):
                of_literal.setdefault(x, []).append(k)
        automaton = ahocorasick.Automaton()
        for x, numbers in of_literal.items():
            automaton.add_word(x, numbers)
        if of_literal:
            automaton.make_automaton()
        for batch in given:
            text = batch.column(batch.schema.get_field_index("text"))
            hits = [sorted({*always, *(k for _, found in (automaton.iter((t or "").lower()) if of_literal else ()) for k in found)}) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.int64()))], [*batch.schema.names, "numbers"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(find, f"{schema}, numbers array<bigint>").select(*texts.columns, F.explode("numbers").alias("number"))


def matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id, first (what the pattern first matches) for texts (text_id, text) and patterns (pattern_id, pattern)."""
    known = held(patterns.where("pattern IS NOT NULL").select("pattern_id", "pattern").withColumn("number", F.monotonically_increasing_id()))
    rows = known.select("number", "pattern").collect()  # the patterns of a list, not of the texts
    own = texts.select("text_id", F.coalesce("text", F.lit("")).alias("text"))
    met = candidates(own, [(r["number"], required_literals(r["pattern"])) for r in rows])
    joined = met.join(F.broadcast(known) if len(rows) <= MOST_PATTERNS else known, "number")
    pattern = F.concat(F.lit("(?i)"), F.col("pattern"))
    return joined.where(F.rlike(F.col("text"), pattern)).select("text_id", "pattern_id", F.regexp_substr(F.col("text"), pattern).alias("first"))


def behaviours(spark) -> DataFrame:
    """pattern_id, pattern, technique, tactic of BEHAVIOURS."""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(BEHAVIOURS)], "pattern_id int, pattern string, technique string, tactic string")


def behaviour_sets(found: DataFrame, patterns: DataFrame, owners: DataFrame) -> DataFrame:
    """owner, tactic, n_texts, n_patterns, techniques of matches (text_id, pattern_id) by owners of texts (text_id, owner)."""
    named = found.join(F.broadcast(patterns.select("pattern_id", F.nullif("technique", F.lit("")).alias("technique"), "tactic")), "pattern_id").join(owners, "text_id")
    return named.groupBy("owner", "tactic").agg(F.countDistinct("text_id").alias("n_texts"), F.countDistinct("pattern_id").alias("n_patterns"), F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("techniques"))
