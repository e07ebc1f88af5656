import zlib
from collections import defaultdict

import numpy as np

from ledgerloom.llm import packing as P

ODD = [(1, None), (2, ""), (3, "  "), (4, "Ünïcode STRASSE ǅ İstanbul x y don't it's 12345 <|endoftext|> é"), (5, "a b " * 9000), (6, "same"), (6, "same"), (7, "ΣΑΣ ὈΔΥΣΣΕΎΣ İ"), (8, "x's. don'T.'s 's'rest a—b.c…d 3x4y e\u0301.\u0301f ...'re it'd've ''ll a1'2s \u00a0b\u2003c")]


def check(rows, docs, tiers):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.default_tokenizer())
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    texts = defaultdict(list)
    for d, t in docs:
        texts[d].append([*tok.encode(t or "", add_special_tokens=False).ids, P.END_ID])
    assert set(texts) == set(pieces)
    for d, own in pieces.items():
        ids = texts[d][0]
        assert sum(r.length for r in own) == sum(map(len, texts[d]))
        if len(texts[d]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                part = ids[at : at + r.length]
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
                at += r.length
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == own[0].tier and at & (at - 1) == 0 and at <= max(tiers)
    return seqs


def test_round_trip(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id + 100, r.text) for r in df.collect()] + ODD
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seqs = check(P.pack(frame).collect(), docs, P.TIERS)
    tokens = sum(r.length for s in seqs.values() for r in s)
    small = sum(r.length for s in seqs.values() for r in s if r.tier < 512)
    assert small < 3 * 1024 and tokens > 100_000
    by_step = defaultdict(int)
    for s in seqs.values():
        by_step[s[0].step] += s[0].tier
    assert max(by_step.values()) <= P.STEP_TOKENS


def test_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", "x")], "doc_id int, text string, start string")
    r = P.pack(df, ids=True).collect()
    assert [x for p in sorted(r, key=lambda p: p.start) for x in p.ids][-1] == P.END_ID
    assert P.pack(df.limit(0)).count() == 0


def test_steps_are_balanced():
    sizes = [4096] * 40 + [2048] * 7 + [512] * 9
    step = P.steps(sizes, 16 * 4096)
    total = defaultdict(int)
    for s, k in zip(sizes, step):
        total[k] += s
    assert sorted(total.values(), reverse=True)[:-1] == [16 * 4096] * (len(total) - 1)
