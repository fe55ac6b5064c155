"""Structured texts as rows: JSON of any depth, delimited lines, XML, JSON lines with bad ones counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held

DELIMITERS = {"comma": ",", "tab": "\t", "pipe": "|", "semicolon": ";"}


def escaped(key: Column) -> Column:
    """A key as a step of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def json_leaves(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pointer, path, value for each leaf of a JSON text: a pointer and a dotted path, and the leaf as text.

    A level is opened at a time until only leaves are left; text that isn't JSON gives no rows. Empty containers are leaves.
    """
    level = rows.select(key, F.lit("").alias("pointer"), F.lit("").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    done = []
    while True:
        kind, body = F.schema_of_variant("v"), F.col("v").cast("string")
        full = F.when(kind.startswith("OBJECT<") & (body != "{}"), "object").when(kind.startswith("ARRAY<") & (body != "[]"), "array")
        marked = held(level.select(key, "pointer", "path", body.alias("body"), full.alias("open")))
        done.append(marked.where("open IS NULL").select(key, "pointer", "path", F.col("body").alias("value")))
        inner = marked.where("open IS NOT NULL")
        if inner.isEmpty():
            return reduce(DataFrame.union, done)
        members = inner.where("open = 'object'").select(key, "pointer", "path", F.explode(F.map_entries(F.from_json("body", "map<string,variant>"))).alias("e")).select(
            key, F.concat("pointer", F.lit("/"), escaped(F.col("e.key"))).alias("pointer"), F.concat_ws(".", F.nullif("path", F.lit("")), F.col("e.key")).alias("path"), F.col("e.value").alias("v")
        )
        items = inner.where("open = 'array'").select(key, "pointer", "path", F.posexplode(F.from_json("body", "array<variant>")).alias("k", "v")).select(
            key, F.concat("pointer", F.lit("/"), F.col("k").cast("string")).alias("pointer"), F.concat("path", F.lit("["), F.col("k").cast("string"), F.lit("]")).alias("path"), "v"
        )
        level = members.union(items)


def delimiter_of(text: Column) -> Column:
    """The name of the delimiter that a text has most of, commas before others; null without any."""
    counts = [F.struct((F.length(text) - F.length(F.replace(text, F.lit(d)))).alias("n"), F.lit(-k).alias("turn"), F.lit(name).alias("name")) for k, (name, d) in enumerate(DELIMITERS.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["name"])


def cells_of(line: Column, delimiter: str) -> Column:
    """The cells of a line: a delimiter within quotes belongs to its cell, quotes go, a doubled one stays once."""
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'[{delimiter}](\s*"(?:[^"]|"")*"[^{delimiter}]*|[^{delimiter}]*)'), F.lit(1))
    return F.transform(raw, lambda c: F.when(F.ltrim(c).startswith('"'), F.replace(F.regexp_replace(c, r'^\s*"((?:[^"]|"")*)"', "$1"), F.lit('""'), F.lit('"'))).otherwise(c))


def delimited_cells(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, line_no, column_no, name, value of delimited texts, whole: the delimiter is found for each text.

    A first line whose cells are all words, and not numbers, is the header; without one, columns have the names c0, c1 and
    so on. Blank lines don't count. A line may have fewer cells than the header, or more: those have no name (null). A null
    or empty text has no cells.
    """
    split = rows.select(key, F.coalesce(delimiter_of(text), F.lit("comma")).alias("d"), F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))

    def cut_at(delimiter: str):
        return lambda line: cells_of(line, delimiter)

    cut = split.select(key, F.coalesce(*[F.when(F.col("d") == name, F.transform("lines", cut_at(d))) for name, d in DELIMITERS.items()]).alias("cells"))
    header = F.forall(F.col("cells")[0], lambda c: c.rlike(r"^[A-Za-z_][A-Za-z0-9_ -]*$"))
    named = cut.where(F.size("cells") > 0).withColumn("has_header", header).withColumn("names", F.col("cells")[0])
    lines = named.select(key, "has_header", "names", F.posexplode("cells").alias("line_no", "line")).where("NOT (has_header AND line_no = 0)")
    cells = lines.select(key, "has_header", "names", "line_no", F.posexplode("line").alias("column_no", "value"))
    name = F.when(F.col("has_header"), F.get("names", F.col("column_no"))).otherwise(F.concat(F.lit("c"), F.col("column_no").cast("string")))
    return cells.select(key, "line_no", "column_no", name.alias("name"), F.trim("value").alias("value"))


def xml_rows(rows: DataFrame, key: str, text: Column, container: str, schema: str) -> DataFrame:
    """key, locator, name, value: the leaves of each repeated element of XML texts, where it stands and what it holds."""
    parsed = rows.select(key, F.from_xml(text, f"{container} array<struct<{schema}>>")[container].alias("items"))
    items = parsed.select(key, F.posexplode("items").alias("k", "item"))
    names = [f.name for f in items.schema["item"].dataType.fields]
    leaves = items.select(key, "k", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col("item")[n].cast("string").alias("value")) for n in names])).alias("x")).where("x.value IS NOT NULL")
    return leaves.select(key, F.concat(F.lit(f"/{container}["), (F.col("k") + 1).cast("string"), F.lit("]/"), F.col("x.name")).alias("locator"), "x.name", "x.value")


def json_line_quality(lines: DataFrame, key: str) -> DataFrame:
    """key, good, bad, confidence of JSON lines (key, line): blank lines don't count, and bad ones lower the confidence."""
    fine = F.try_parse_json("line").isNotNull()
    counts = lines.where("trim(line) <> ''").groupBy(key).agg(F.count_if(fine).alias("good"), F.count_if(~fine).alias("bad"))
    return counts.withColumn("confidence", F.round(0.95 * F.col("good") / (F.col("good") + F.col("bad")), 6))


def schema_of_records(leaves: DataFrame) -> DataFrame:
    """path, n: the union of the dotted paths of all records, indexes left out, and how many leaves each has."""
    return leaves.groupBy(F.regexp_replace("path", r"\[[0-9]+\]", "[]").alias("path")).agg(F.count(F.lit(1)).alias("n"))
