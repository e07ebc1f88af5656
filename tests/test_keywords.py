"""Keywords from a relation against plain containment, in one block and in many."""

import random

import pytest

from ledgerloom.operators import keywords as K


def sample():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abÄ é") for _ in range(n))
    keys = [word(rng.randint(1, 6)) for _ in range(300)] + ["AB", "ab", None, "", "no such keyword"]
    texts = [(i, word(rng.randint(0, 60))) for i in range(120)] + [(7, "abba"), (7, "abba"), (None, "ÄB"), (500, None), (501, "")]
    return keys, texts


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_contained(spark, block):
    keys, texts = sample()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "id long, text string, other string")
    got = sorted(((r.id, r.keyword) for r in K.contained(df, spark.createDataFrame([(k,) for k in keys], "keyword string"), block_bytes=block).collect()), key=str)
    folded = {k.lower() for k in keys if k}
    assert got == sorted(((i, k) for i, t in texts if t for k in folded if k in t.lower()), key=str)


def test_no_keywords_and_no_texts(spark):
    texts, none = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "keyword string")
    assert K.contained(texts, none).count() == 0 and K.contained(texts.limit(0), spark.createDataFrame([("a",)], "keyword string")).count() == 0


def test_masks(spark):
    keys, texts = sample()
    bits = {k.lower(): i for i, k in enumerate(dict.fromkeys(k.lower() for k in keys if k is not None))}
    df = spark.createDataFrame(texts, "id long, text string").where("text IS NOT NULL")
    words = -(-len(bits) // 62)
    for r in K.masks(df.withColumnRenamed("id", "i").selectExpr("i", "text", "text AS t"), bits, words).collect():
        found = {k for k, b in bits.items() if r[f"_b{b // 62}"] >> b % 62 & 1}
        assert found == {k for k in bits if k in r.t.lower()}
