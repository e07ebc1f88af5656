import hashlib
import re

import pytest

from ledgerloom.llm import spotsigs as S
from ledgerloom.llm.kernel import Text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def chains(t):
    """Plain restatement: the chains as word tuples."""
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    anchors, out = set(S.ANCHORS), set()
    for i, a in enumerate(w):
        if a in anchors:
            rest = [x for x in w[i + 1 :] if x not in anchors][: S.CHAIN]
            if len(rest) == S.CHAIN:
                out.add((a, *rest))
    count = sum(1 for i, a in enumerate(w) if a in anchors and sum(x not in anchors for x in w[i + 1 :]) >= S.CHAIN)
    if count < S.LEAST:
        out = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else ({t} if t else set())
    return out


def jaccard(a, b):
    return float(a == b) if not a or not b else len(a & b) / len(a | b)


def neighbour_rows(rows):
    rows = sorted(rows, key=lambda r: r[1] or "")
    rows.sort(key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[:k]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(chains(t), chains(e)), 6), round(jaccard(chains(t), chains(nxt)), 6)))
    return out


ODD = [(5, "the quick brown fox and the lazy dog of my old house in the big city by the sea"), (9, None), (3, ""), (4, "?!"), (77, "word"), (78, "Ünï the çödé"), (2, "the quick brown fox"), (1, "x " * 3000 + "the end of it is near now")]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_equals_plain_form(spark, ranges):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id * 3 + 100, r.text) for r in df.collect()] + ODD
    got = S.neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ranges=ranges).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 6), round(r.near_next, 6)) for r in got), key=key) == sorted(neighbour_rows(rows), key=key)
    by = {}
    for r in got:
        by.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_repeats_lone_and_empty(spark):
    one = spark.createDataFrame([(7, "the lone text is here and the rest of it too")], "doc_id long, text string")
    r = S.neighbours(one).first()
    assert r.near_next == 1.0 and r.doc_id == 7
    assert S.neighbours(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, "a b c"), (7, "a b c"), (None, "d e")], "doc_id long, text string")
    assert S.neighbours(twice).count() == 3


def test_length_partitions_bound_likeness():
    for a in range(1, 200):
        for b in range(a, 200):
            if a / b >= 0.8:
                assert S.length_partition(b, 0.8) - S.length_partition(a, 0.8) <= 1
    sets = S.signature_sets(Text.of_strings(["the one two of three four in five six and seven eight"] * 2), S._anchor_hashes())
    assert S.likeness(*sets) == 1.0 and S.likeness(sets[0], sets[1][:1], least=0.9) == 0.0
