"""Partitioned tables changed in place, and pages of PDF files."""

import glob
import os
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import partitioned as P
from ledgerloom.sources import pdf

SCHEMA = "k long, v string"


def table(spark, path, n=200):
    P.create(spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v")), path, ["k"], 8)
    return {k: f"v{k}" for k in range(n)}


def rows(spark, path):
    return {r.k: r.v for r in P.read(spark, path, SCHEMA).collect()}


def files(path):
    out = {}
    for f in glob.glob(f"{path}/part=*/*.parquet"):
        out.setdefault(int(f.split("part=")[1].split("/")[0]), set()).add(os.path.basename(f))
    return out


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    want, before = table(spark, path), None
    before = files(path)
    changes = spark.createDataFrame([(3, "new"), (1003, "added")], SCHEMA)
    parts = P.upsert(spark, path, SCHEMA, changes, ["k"], 8)
    want |= {3: "new", 1003: "added"}
    after = files(path)
    assert rows(spark, path) == want and P.read(spark, path, SCHEMA).count() == len(want)
    assert 1 <= len(parts) <= 2 and all((after[p] == before[p]) == (p not in parts) for p in range(8))
    assert P.upsert(spark, path, SCHEMA, changes.limit(0), ["k"], 8) == [] and files(path) == after
    assert P.upsert(spark, path, SCHEMA, changes, ["k"], 8) == parts and rows(spark, path) == want  # a repeat changes nothing


def test_update_and_delete(spark, tmp_path):
    path = str(tmp_path / "t")
    want = table(spark, path)
    before = files(path)
    parts = P.update(spark, path, SCHEMA, F.col("k").isin(5, 6), {"v": F.concat("v", F.lit("!"))})
    want |= {5: "v5!", 6: "v6!"}
    assert rows(spark, path) == want and all((files(path)[p] == before[p]) == (p not in parts) for p in range(8))
    assert P.update(spark, path, SCHEMA, F.col("k") == -1, {"v": F.lit("x")}) == []
    one = P.read(spark, path, SCHEMA).where("part = 3").select("k").collect()
    keys = spark.createDataFrame([(r.k,) for r in one] + [(-7,), (one[0].k,)], "k long")
    assert P.delete(spark, path, SCHEMA, keys, ["k"]) == [3]
    assert rows(spark, path) == {k: v for k, v in want.items() if k not in {r.k for r in one}} and 3 not in files(path)  # a partition without rows goes
    P.upsert(spark, path, SCHEMA, spark.createDataFrame([(one[0].k, "back")], SCHEMA), ["k"], 8)
    assert rows(spark, path)[one[0].k] == "back" and 3 in files(path)


TEXTS = ["one page", "", "two\nlines (with) \\ signs", "اردو متن é 😀"]


def deflated(texts):
    """Another writer's file: binary marks, deflated streams in arrays, a tree of two levels, an update that replaces a page."""
    out, at = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n", {}

    def add(n, body):
        nonlocal out
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)

    def stream(n, text, filtered=True):
        raw = b"BT (" + text.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET"
        data = zlib.compress(raw) if filtered else raw
        add(n, b"<< /Length %d %s>>\nstream\r\n" % (len(data), b"/Filter /FlateDecode " if filtered else b"") + data + b"\r\nendstream")

    def xref(numbers, before=None):
        nonlocal out
        start = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at[n]) for n in numbers)
        out += b"trailer\n<< /Size 20 /Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (b"/Prev %d " % before if before else b"", start)
        return start

    add(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    add(2, b"<< /Type /Pages /Count 3 /Kids [3 0 R 4 0 R] >>")
    add(3, b"<< /Type /Pages /Count 2 /Parent 2 0 R /Kids [5 0 R\n6 0 R] >>")
    add(4, b"<< /Type /Page /Parent 2 0 R /Contents [9 0 R 10 0 R] >>")
    add(5, b"<< /Type /Page /Parent 3 0 R /Contents 7 0 R >>")
    add(6, b"<< /Type /Page /Parent 3 0 R >>")
    stream(7, "old first")
    stream(9, texts[1])
    stream(10, texts[2], filtered=False)
    first = xref([1, 2, 3, 4, 5, 6, 7, 9, 10])
    stream(7, texts[0])
    xref([7], first)
    return out


def test_pages_of_files(spark, tmp_path):
    whole = pdf.written(TEXTS).encode()
    other = deflated(["new first", "a (b) \\ c", "end"])
    circle = whole.replace(b"/Kids [3 0 R", b"/Kids [2 0 R")
    damaged = {"cut": whole[: len(whole) // 2], "empty": b"", "text": b"no pdf", "offset": whole.replace(b"startxref\n", b"startxref\n9"), "circle": circle, "shifted": whole.replace(b"%PDF-1.4\n", b"%PDF-1.4\nxx")}
    for name, data in {"a": whole, "b": other, **damaged}.items():
        (tmp_path / f"{name}.pdf").write_bytes(data)
    (tmp_path / "c.txt").write_bytes(whole)
    got = {}
    for r in pdf.read(spark, str(tmp_path)).orderBy("path", "page").collect():
        got.setdefault(os.path.basename(r.path), []).append((r.page, r.pages, r.text))
    assert got == {"a.pdf": [(i + 1, 4, t) for i, t in enumerate(TEXTS)], "b.pdf": [(1, 3, "new first"), (2, 3, ""), (3, 3, "a (b) \\ c\nend")]}


def test_null_content(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(pdf.written(["x"]).encode()))], "id int, content binary")
    assert [tuple(r)[:3] for r in pdf.split(df).collect()] == [(2, 1, 1)]


@pytest.mark.parametrize("n", [0, 1, 30])
def test_round_trip(n):
    texts = [f"page {i} (é)" for i in range(n)]
    assert [t for *_, t in pdf.pages(pdf.written(texts).encode())] == texts
