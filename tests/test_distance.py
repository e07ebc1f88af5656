"""Bit-parallel edit distance against the table, and against the built-in."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import distance
from ledgerloom.functions.distance import BLOCK, edit_distance, few_edits, page_distance


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_against_the_table():
    rng = random.Random(4)
    for n in range(400):
        a, b = ("".join(rng.choice("abcé" if n % 2 else "ab") for _ in range(rng.randint(0, 90))) for _ in "xy")
        want = table(a, b)
        assert edit_distance(a, b) == want
        for most in (0, want - 1, want, want + 1, 40):
            assert edit_distance(a, b, most) == (want if want <= most else None)


def test_blocks_and_edits():
    rng = random.Random(5)
    page = "".join(rng.choice("abcdefgh ") for _ in range(3 * BLOCK + 7))
    other = "".join(rng.choice("abcdefgh ") for _ in range(3 * BLOCK - 50))
    want = table(page, other)
    assert edit_distance(page, other) == want == edit_distance(other, page, want) and edit_distance(page, other, want - 1) is None
    assert edit_distance(page, page[:100] + "x" + page[101:300] + page[302:]) == 3


def test_few_edits_against_the_table():
    rng = random.Random(6)
    for n in range(300):
        a = [rng.choice("abc\U0001f600 ") for _ in range(rng.randint(1, 120))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "a", "xy"])
        a, b = "1" + "".join(a), "2" + "".join(b)
        want = table(a, b)
        assert few_edits(a, b, 130) == few_edits(a, b, want) == want and few_edits(a, b, want - 1) is None and edit_distance(a, b) == want


def test_a_long_page_with_few_edits_needs_no_table(monkeypatch):
    rng = random.Random(7)
    page = " ".join(rng.choice(["the", "deed", "of", "sale. And", "plot"]) for _ in range(30_000))
    monkeypatch.setattr(distance, "_bits", None)
    assert edit_distance(page, page[:5] + "x" + page[6:70_000] + page[70_002:]) == 3


@pytest.mark.parametrize("most", [None, 20])
def test_against_the_built_in(spark, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500").select("doc_id", "text")
    x = docs.withColumn("edited", F.regexp_replace("text", "th", "ht")).unionByName(spark.createDataFrame([(-1, None, "a"), (-2, "", "abc"), (-3, "é", "ê")], "doc_id long, text string, edited string"))
    built_in = F.levenshtein("text", "edited") if most is None else F.levenshtein("text", "edited", most)
    rows = x.select("doc_id", page_distance(F.col("text"), F.col("edited"), most).alias("got"), F.nullif(built_in, F.lit(-1)).alias("want")).collect()
    assert len(rows) > 100 and all(r.got == r.want for r in rows)
