import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import suffix_dedup as S


def brute(rows, n):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + n] for _, t in texts for i in range(len(t) - n + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def rows(n, seed=2):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdeé \n") for _ in range(k))
    hot, passages = text(n + 7), [text(n + rng.randrange(-8, 60)) for _ in range(6)]
    out = []
    for i in range(40):
        t = text(rng.randrange(0, 3 * n))
        if i % 2:
            t = t + hot + text(rng.randrange(0, n))
        if i % 3 == 0:
            p = rng.choice(passages)
            t += p + text(9) + rng.choice([p, ""])
        out.append((i, t))
    line = text(11)
    return [*out, (100, line * 40), (101, line * 9), (102, None), (103, ""), (104, out[5][1]), (None, out[7][1]), (105, "x" * (2 * n)), (106, "short"), (106, "short"), (107, out[1][1] + "tail"), (107, out[1][1] + "tail")]


@pytest.mark.parametrize("group", [200, 2])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "CHUNK", 3)
    monkeypatch.setattr(S, "BATCH_BYTES", 2000)
    data = rows(60)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = [tuple(r)[:5] for r in S.dedupe(df, length=60, gram=20).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r)) == brute(data, 60)


def test_more_contexts_than_a_group_holds(spark):
    """One passage in so many different surroundings that its anchors exceed GROUP as it is."""
    rng = random.Random(9)
    text = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    hot = text(75)
    data = [(i, text(rng.randrange(20, 60)) + hot + text(rng.randrange(20, 60))) for i in range(S.GROUP + 40)]
    data += [(5000 + i, data[i][1][3:]) for i in range(30)]
    got = sorted(tuple(r)[:5] for r in S.dedupe(spark.createDataFrame(data, "doc_id long, text string").repartition(3), length=60, gram=20).collect())
    assert got == brute(data, 60)


def test_planted_passages_of_over_fifty_words(spark):
    """They go from LENGTH bytes on; one byte less stays where its surroundings differ, and goes at a shorter length."""
    rng = random.Random(6)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    data = []
    for n in (399, 400):
        p = text(60)[:n]
        assert len(p.split()) > 50
        data += [(10 * n + i, text(30) + "xyz"[i] + p + "uvw"[i] + text(30)) for i in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for length, gram, least in ((400, 100, 400), (200, 50, 399)):
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.dedupe(df, length=length, gram=gram).collect()}
        assert got == {d: (d // 10, 1) if d // 10 >= least else (0, 0) for d, _ in data}


def test_keep_first_leaves_one_of_each(spark):
    rng = random.Random(4)
    text = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    p = text(150)
    data = [(1, text(80) + p + text(40)), (2, text(30) + p), (3, p + text(90) + p), (4, text(200))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in S.dedupe(df, length=60, gram=20, keep_first=True, kept=True).collect()}
    assert (got[1].n_removed, got[4].n_removed) == (0, 0) and 150 <= got[2].n_removed <= 152 and 300 <= got[3].n_removed <= 304
    assert sum(p.encode() in r.kept for r in got.values()) == 1


def test_given_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r)[:5] for r in S.dedupe(df).collect())
    assert got == brute([tuple(r) for r in df.collect()], 400)


def test_longest_previous_factor():
    rng = np.random.default_rng(0)
    for limit in (4, 7, 50):
        for n in (1, 2, 30, 120):
            x = rng.integers(0, 3, n)
            want = [max((next((k for k in range(limit + 1) if k == limit or i + k >= n or x[i + k] != x[j + k]), 0) for j in range(i)), default=0) for i in range(n)]
            assert S.longest_previous(x, limit).tolist() == want


def test_full_matches_are_longest_factors_of_the_limit():
    rng = np.random.default_rng(1)
    for limit in (1, 2, 5, 7, 40):
        for n in (1, 2, 50, 300):
            x = np.concatenate([rng.integers(1, 3, n), rng.integers(1, 400, n // 3), rng.integers(1, 3, n)])
            rank, shared = S.suffix_ranks(x, limit)
            pad = [tuple(x[i : i + limit]) for i in range(len(x))]
            assert rank.tolist() == [sum(p < q for p in pad) for q in pad]
            for mirrored in (False, True):
                found = S.full_matches(rank, shared, mirrored)
                whole = np.arange(len(x)) + limit <= len(x)
                assert (found & whole).tolist() == ((S.longest_previous(x, limit, mirrored) >= limit) & whole).tolist()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedupe(df).count() == 0
