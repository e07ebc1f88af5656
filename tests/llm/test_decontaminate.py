import hashlib
import re

import numpy as np
import pytest

from ledgerloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    pats = []
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        pats += [(str(i), tuple(w))] if len(w) < size else [(str(i), tuple(w[k : k + size])) for k in range(len(w) - size + 1)]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, p in pats:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(i)
        names = sorted(found)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEM = "One two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, "x " + ITEM.upper() + " y. " + ITEM),
    (2, ""),
    (3, None),
    (4, "... --- !!!"),
    (5, "one two three four five six seven eight nine"),
    (6, "Æble grød; short item! and ünïcode"),
    (7, "a b " * 4000 + ITEM + " a b" * 3000),
    (8, "short item"),
    (8, "short item"),
    (9, "rep rep rep rep rep rep rep rep rep rep rep rep"),
]
ITEMS = [(10, ITEM), (2, "Short, item"), (3, None), (4, ""), (5, "grød"), (7, "rep " * 11), (7, "rep " * 11), (None, "two three"), (11, ITEM)]


@pytest.mark.parametrize("block", [500_000, 2])
def test_equals_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(tuple, D.summary(D.find(docs, bench, block_patterns=block)).collect()))
    assert got == brute(DOCS, ITEMS)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "hits")], "doc_id long, text string, n_words int, items string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.summary(D.find(docs, none)).collect()] == [(1, 2, 0, 0)]
    assert D.find(docs.limit(0), none).count() == 0
    kept = D.clean(docs, spark.createDataFrame([(1, "zz")], "item_id long, text string"))
    assert kept.columns == docs.columns and kept.count() == 1


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, D.summary(D.find(docs.select("doc_id", "text"), bench)).collect()))
    text = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    sizes = {r[0]: r for r in got}
    # brute force by sets of windows: the texts are too long for nested loops
    from collections import defaultdict

    where = defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in [tuple(w)] if len(w) < 10 else [tuple(w[k : k + 10]) for k in range(len(w) - 9)]:
            where[p].add(str(i))
    lengths = {len(p) for p in where}
    for d, t in text:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if x := where.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        assert sizes[d][1:4] == (len(w), len(hit), len(found))


def test_bytes_decide(spark, monkeypatch):
    # Even if all words had one hash, only equal words are hits.
    monkeypatch.setattr(D.Text, "hashes", lambda self, s, e, fold=True: np.full(len(s), 7, np.uint64))
    block = D.Block()
    for item, windows in zip("ab", D.item_windows(["One two three", "one Twa thr"], 3)):
        block.add(item, windows)
    n, spans, items = D.search_batch(D.Text.of_strings(["x one TWO three one two thre e", "one twa thr", "onet wo three one two"]), block.close())
    assert spans == [[(1, 4)], [(0, 3)], []] and items == [{"a"}, {"b"}, set()]


def test_words_that_collide_in_polynomial_hashes(spark):
    w = "a"
    while len(w) < 4096:
        w += w.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048, 4096):
        a = w[:n]
        b = a.translate(str.maketrans("ab", "ba"))
        docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y")], "doc_id long, text string")
        got = D.summary(D.find(docs, spark.createDataFrame([(1, a)], "item_id long, text string"))).collect()
        assert {r.doc_id: r.n_hit for r in got} == {1: 1, 2: 0}


def test_one_item_longer_than_a_block(spark):
    words = [f"w{i}" for i in range(700)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (3, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id long, text string")
    cut = list(D.blocks(bench, 10, block_patterns=50))
    assert len(cut) == 14 and sum(b.entries for b in cut) == 691 + 2 and all(b.entries <= 50 for b in cut)
    docs = spark.createDataFrame([(1, "x " + " ".join(words[300:420]) + " y"), (2, " ".join(words[5:15])), (3, "w1 w2")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in D.summary(D.find(docs, bench, block_patterns=50)).collect()}
    assert got == {1: (122, 120, 1), 2: (10, 10, 3), 3: (2, 0, 0)}
