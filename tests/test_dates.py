"""Date hints against a plain scanner."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D

TEXTS = [
    "2024-01-30 and 2024-01-30 again, 2024-13-01, 2024-00-10, 2024-02-31\n30.01.2024 31/12/1999\n05-06-2024, 05-06-2024 5/6/2024",
    "12.13.2020 is kept, 0.13.2020 is not, 13.13.2020 neither; 45.01.2020 no; 32.1.2020",
    "\n\n3 Jan 2024, 4-january-2024, 5. MAY . 2021\n31 Sept 2020 31 sep 2020, 32 dec 2020, 6Aug2022, xJan 2024",
    "30 جنوری 2024 اور 5-مئی-2021\n7 جولائی\n 2019; تاریخ30-01-2024 12024-01-302",
    "", None, "no date", "1234-12-123 99.99.9999 1.1.20201 2020-01-01", "a 1 jan 2020 b 01.01.2020 c 2020-01-01\n\n1 jan 2020",
]


def plain(text, strict=True):
    out, seen = [], set()

    def add(m, value, confidence):
        key = value or m[0]
        if key not in seen:
            seen.add(key)
            out.append((value, m[0], text[: m.start()].count("\n"), confidence))

    text = text or ""
    for m in re.finditer(D.ISO, text):
        if 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31:
            add(m, m[0], "high")
    for m in re.finditer(D.NUMERIC, text):
        d, mo = int(m[1]), int(m[2])
        value = f"{m[3]}-{mo:02d}-{d:02d}"
        if not strict:
            if 1 <= mo <= 12 and 1 <= d <= 31:
                add(m, value, "med")
        elif d > 12:
            if 1 <= mo <= 12 and d <= 31:
                add(m, value, "high")
        elif mo > 12:
            if d >= 1:
                add(m, value, "high")
        else:
            add(m, None, "low")
    for months in (D.URDU_MONTHS, D.ENGLISH_MONTHS):
        for m in re.finditer(D.named(months), text, re.IGNORECASE):
            if 1 <= int(m[1]) <= 31:
                add(m, f"{m[3]}-{months[m[2].lower()]:02d}-{int(m[1]):02d}", "high")
    return out


@pytest.mark.parametrize("strict", [True, False])
def test_hints(spark, strict):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {r.i: [tuple(h) for h in r.h] for r in df.select("i", D.date_hints(F.col("text"), strict).alias("h")).collect()}
    assert got == {i: plain(t, strict) for i, t in enumerate(TEXTS)}
    assert sum(map(len, got.values())) > 12


def test_over_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: [tuple(h) for h in r.h] for r in docs.select("doc_id", D.date_hints(F.col("text")).alias("h")).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs.collect()}
