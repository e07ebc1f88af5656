"""Fields and hints of pages against plain scanners with Python's regular expressions."""

import re

from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.operators import fields as FD
from ledgerloom.operators import hints as H
from tests.test_dates import plain as dates

PAGES = [
    "Plot No. 12345 then plot 77, Block E of Phase VIII\nno. 5 mouza Kot Lakhpat\nTehsil: Model Town", "PLOT #  9 block - f phase-2 near Bahria Town and DHA", "Khasra No. 12/3, khasra 12/3 khasra no 44-1 Khasra 7", "Registry Date: 1/2/1999 registration date 03-04-2001 Registration No: 55 registry no. 66",
    "e stamp number AB-1 estamp: PB12345 stamp paper id ZZ-99999", "", None, "nothing here", "in the Gulberg area of x", "MODEL TOWN, Lahore. Defence", "phase IX\n\nblock q", "district  Lahore\nCity Court 12",
    "Khewat No. 12 khewat: 13\n14 Khewat; کھاتہ نمبر 15 کھیوٹ 16", "Khatoni - 5, 5 to 9 Khatoni 7 تا 8 کھتونی\nخسرہ 12/3 4/5 خسرہ", "انتقال 77 Mutation No. 78 79 intiqal mutation 77", "4 kanal 2 marla, 3 کنال 1 مرلہ; 500 sq. ft. 600 مربع فٹ", "35202-1234567-1 3520212345671 1234567890123 12345678901234", "2020-01-01 1.2.2020 3.4.2021 31 dec 2019",
]


def plain_fields(text):
    own = text or ""
    low, out = own.lower(), []
    for field, patterns in FD.PATTERNS.items():
        found = []
        for p, c in patterns:
            for m in re.finditer(p, low, re.I):
                v = m[1].strip()
                v = v.upper() if field == "property.block" else v
                if field == "property.plot_number" and not 1 <= int(v) <= 9999 or field == "stamp.estamp_id_or_number" and len(v) < 5:
                    continue
                if v not in [f[1] for f in found] or field != "property.khasra_numbers":
                    found.append((field, v, m[0], low[: m.start()].count("\n"), c))
        out += found if field == "property.khasra_numbers" else found[:1]
    for name in FD.SCHEMES:
        m = re.search(rf"\b{re.escape(name)}\b", low)
        if m:
            capital = re.search(FD._NAME, own[max(0, m.start() - 20) : m.end() + 20])
            out.append(("property.scheme_name", capital[1] if capital else name.title(), name, low[: m.start()].count("\n"), 0.85))
            break
    return out


def plain_hints(text, most):
    own, out, seen = text or "", [], set()

    def family(kind, pattern, groups, confidence):
        for m in re.finditer(pattern, own, re.I):
            yield kind, "-".join(m[int(g)] for g in groups.split("-")) if groups else None, m[0], own[: m.start()].count("\n"), confidence

    every = [h for n in H.NUMBERS for h in family(*n)] + [("date", v, raw, line, c) for v, raw, line, c in dates(own)] + [h for r in H.REFERENCES for h in family(*r)]
    for h in every:
        if (h[0], h[1] or "") not in seen:
            seen.add((h[0], h[1] or ""))
            out.append(h)
    return out[:most]


def rows(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*PAGES, *docs])], "i int, text string")


def test_fields(spark):
    df = rows(spark).cache()
    got = {r.i: [tuple(h) for h in r.h] for r in df.select("i", FD.page_fields(F.col("text")).alias("h")).collect()}
    assert got == {r.i: plain_fields(r.text) for r in df.collect()}
    assert {h[0] for hits in got.values() for h in hits} == {*FD.PATTERNS, "property.scheme_name"}


def test_hints(spark):
    df = rows(spark).cache()
    for most in (100, 2):
        got = {r.i: [tuple(h) for h in r.h] for r in df.select("i", H.domain_hints(F.col("text"), most=most).alias("h")).collect()}
        assert got == {r.i: plain_hints(r.text, most) for r in df.collect()}
    assert {r[0] for r in plain_hints("\n".join(p for p in PAGES if p), 1000)} == {"cnic", "date", "khewat", "khatoni", "khatoni_range", "khasra", "mutation", "area"} and D.ISO
