"""Periodic runs against a brute force over all lags and positions."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import periodic, queries


def smallest(w):
    return next(p for p in range(1, len(w) + 1) if w[p:] == w[: len(w) - p])


def plain(words, least=24, exponent=3):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q) and smallest(words[i : i + length]) == q:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "one two", "a " * 23, "a " * 24, "a b " * 12, "a b c " * 8, "x " * 30 + "y " * 40, "a\tb\x0bc  " * 9 + "end"]
    for _ in range(240):
        alphabet = "ab" if rng.random() < 0.5 else "abcdefgh"
        words = []
        while len(words) < rng.choice([10, 40, 120, 260]):
            if rng.random() < 0.4:
                words += [rng.choice(alphabet) for _ in range(rng.randint(1, 30))]
            else:
                unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 14))]
                words += (unit * rng.randint(2, 9))[: rng.randint(5, 90)]
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    return out


ROWS = [(k, t) for k, t in enumerate(texts())] + [(None, "p q " * 20), (7, "same " * 50), (7, "same " * 50)]
COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("large", [1 << 20, 60])
def test_runs_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(periodic, "LARGE", large)
    monkeypatch.setattr(periodic, "WORK", 500)  # several ranges of lags for a text
    monkeypatch.setattr(periodic, "PROBES", 100)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("start", F.lit("own"))
    found = periodic.find(docs.withColumn("text", periodic.tiled(F.col("doc_id"), F.col("text"))))
    assert got(found) == sorted((expected(*r) for r in ROWS), key=str)
    assert sum(r[1] for r in got(found)) > 100
    assert all([tuple(x) for x in r.runs] == sorted([tuple(x) for x in r.runs], key=lambda x: (x[0], x[2])) and len(r.runs) == r.n_runs for r in found.collect())


def test_empty_and_very_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find(none).count() == 0
    text = "w " * 5_000 + " ".join(f"u{i}" for i in range(20_000)) + " x y z" * 2_000
    df = spark.createDataFrame([(1, text), (2, "a" * 3_000_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic.find(df).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 5000, 1), (25000, 6000, 3)] and rows[1].exponent_milli == 5_000_000
    assert rows[2].n_runs == 0
    with pytest.raises(ValueError):
        periodic.find(none, least=4, exponent=2)


def test_query_takes_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("n_chars < 2500").collect()
    rows = {r[0]: r for r in got(queries.QUERIES["op13_periodic_runs"](spark, sf))}
    assert len(rows) == 200
    assert all(rows[d.doc_id] == expected(d.doc_id, d.text) for d in docs)
