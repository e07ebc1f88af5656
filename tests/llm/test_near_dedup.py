import random
import re

import numpy as np

from ledgerloom.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, size):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def brute(rows, size):
    sets = {d: shingles(t, size) for d, t in rows if d is not None}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), top(d), top(d) == d) for d, _ in rows if d is not None)


def rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for base in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([60, 120, 400]))]
        for copy in range(rng.choice([1, 2, 12])):
            w = list(text)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append((len(out) * 7 % 1009, " ".join(w)))
    # a chain, each link of which is near only to the next
    w = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(12):
        w[k * 14] = w[k * 14 + 4] = w[k * 14 + 8] = f"new{k}"
        out.append((2000 - k, "  ".join(w)))
    return [*out, (5000, None), (5001, ""), (5002, " \n"), (5003, "a B c"), (5004, "A b C"), (5005, "a b"), (5004, "A b C"), (None, "a b c")]


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    for size in (4, 5):
        got = N.near_duplicates(df, size).collect()
        assert sorted(map(tuple, (r for r in got if r.doc_id is not None))) == brute(data, size)
        assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_given_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, N.near_duplicates(df, 4).collect()))
    assert got == brute([tuple(r) for r in df.collect()], 4)


def test_tiles_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 3)
    monkeypatch.setattr(N, "PER_SALT", 2)
    data = rows(5)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = N.near_duplicates(df, 4).where("doc_id IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == brute(data, 4)


def test_empty_and_pipeline_form(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "en", 3), (2, "a b c d e f", "fr", 4), (3, None, None, 5)], "doc_id long, text string, kept string, n_shingles int")
    assert N.near_duplicates(df.limit(0)).count() == 0
    out = N.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_bitmaps_keep_pairs_at_the_threshold(spark):
    # 72 of 90 shingles in common; two of the common ones share their low 16 bits.
    common, a, b = list(range(71)), list(range(100, 109)), list(range(200, 209))
    low = [np.array(sorted(common + own), np.uint16).tobytes() for own in (a, b)]
    sig = bytes(N.HASHES)
    rows = [(1, 0, 0, 0, d, d, 81, sig, x) for d, x in zip((5, 6), low)]
    tiles = spark.createDataFrame(rows, "key long, t1 int, t2 int, side int, doc_id long, label long, n_shingles long, sig binary, low binary").coalesce(1)
    assert [tuple(r) for r in N._tiles(tiles, 80, 100).collect()] == [(5, 6)]
    rng = np.random.default_rng(1)
    for union in (20, 25, 40, 50, 60, 90, 100, 150, 200, 4000, 40000, 120000):
        for _ in range(2000 if union < 1000 else 20):
            h = rng.integers(0, 1 << 16, union)
            in_both = union * 4 // 5
            x, y = h[: in_both + (union - in_both) // 2], np.append(h[:in_both], h[in_both + (union - in_both) // 2 :])
            bx, by = np.unique(x), np.unique(y)
            both = len(np.intersect1d(bx, by, assume_unique=True))
            assert N.may_link(both, len(x), len(y), len(x) - len(bx), len(y) - len(by), 80, 100)
    assert not N.may_link(10, 50, 50, 0, 0, 80, 100)


def test_pairs_at_exactly_four_fifths_beside_a_smaller_document(spark):
    # Pairs that have 80 of 100 shingles in common, each with a smaller id in its buckets that is linked to neither.
    rng = random.Random(11)
    size, data, want = 4, [], {}
    for k, union in enumerate([20, 25, 40, 50, 80, 100, 150, 200] * 12):
        both = union * 4 // 5
        own = (union - both) // 2
        word = lambda tag, n: [f"{tag}{k}_{i}" for i in range(n)]
        start = word("c", both + size - 1)
        a, b = start + word("a", own), start + word("b", union - both - own)
        third = start[: max(size, len(start) * 7 // 10)] + word("t", own)
        ids = sorted(rng.sample(range(10**6), 2))
        data += [(k - 10**6, " ".join(third)), (ids[0] * 1000 + k, " ".join(a)), (ids[1] * 1000 + k, " ".join(b))]
        want[ids[0] * 1000 + k] = want[ids[1] * 1000 + k] = ids[0] * 1000 + k
        sets = [shingles(t, size) for _, t in data[-3:]]
        assert 100 * len(sets[1] & sets[2]) == 80 * len(sets[1] | sets[2])
        assert all(100 * len(sets[0] & x) < 80 * len(sets[0] | x) for x in sets[1:])
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), size).collect()}
    assert {d: got[d] for d in want} == want and all(got[d] == d for d in got if d < 0)


def test_words_that_collide_in_polynomial_hashes(spark):
    a, b = thue_morse(1024)
    texts = [f"x y z {w} u v w" for w in (a, b)]
    df = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")
    assert sorted(r.component_id for r in N.near_duplicates(df, 4).collect()) == [1, 2]


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))
