"""Structured texts with quotes, unequal lines, nulls and other oddities."""

from pyspark.sql import functions as F

from proofgrid.sources import structured


def cells(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    found = structured.delimited_cells(rows, "k", F.col("body")).collect()
    return sorted(((r["k"], r["line_no"], r["column_no"], r["name"], r["value"]) for r in found), key=str)


def test_delimited_cells_with_quotes(spark):
    assert cells(spark, 'name,note\n"Doe, Jane","said ""no"""\nx, plain ') == [
        (0, 1, 0, "name", "Doe, Jane"), (0, 1, 1, "note", 'said "no"'), (0, 2, 0, "name", "x"), (0, 2, 1, "note", "plain"),
    ]


def test_delimited_cells_of_unequal_lines(spark):
    assert cells(spark, "a|b\n1\n\n1|2|3\n|5") == [
        (0, 1, 0, "a", "1"), (0, 2, 0, "a", "1"), (0, 2, 1, "b", "2"), (0, 2, 2, None, "3"), (0, 3, 0, "a", ""), (0, 3, 1, "b", "5"),
    ]


def test_delimited_cells_of_every_delimiter(spark):
    for d in structured.DELIMITERS.values():
        assert cells(spark, f"7{d}8") == [(0, 0, 0, "c0", "7"), (0, 0, 1, "c1", "8")]


def test_delimited_cells_of_nothing(spark):
    assert cells(spark, None, "", " \n ") == []
    assert cells(spark, "alone\n3") == [(0, 1, 0, "alone", "3")]
