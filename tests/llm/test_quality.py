"""Quality: FTRL against a plain loop, features against a plain count, held-out accuracy, odd rows."""

import math

import numpy as np
import pytest

from ledgerloom.llm import quality
from ledgerloom.llm.kernel import Text

ODD = [(-1, None), (-2, ""), (-3, " \n"), (-4, "the the the"), (-4, "the the the"), (-6, "a" * 50_000), (-7, "word " * 200_000)]


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    got = quality.quality(rows, labels).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
    true = {r.doc_id: r.quality for r in labels.collect()}
    p = np.array([(r.predicted, true[r.doc_id]) for r in got if r.held_out and r.doc_id in true])
    assert len(p) > 1000
    assert p[p[:, 1] == 1, 0].mean() > 0.99 and p[p[:, 1] == 0, 0].mean() < 0.1
    empty = {r.score for r in got if r.doc_id in (-1, -2, -3)}
    assert len(empty) == 1


def plain_ftrl(rows, labels, epochs):
    z, n, zb, nb = {}, {}, 0.0, 0.0
    a, beta, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get(i, 0.0))) / a + l2)

    for _ in range(epochs):
        for x, y in zip(rows, labels):
            b = -zb / ((beta + math.sqrt(nb)) / a)
            w = {i: weight(i) for i in x}
            e = 1 / (1 + math.exp(-(b + sum(w[i] * v for i, v in x.items())))) - y
            for i, v in x.items():
                g, before = e * v, n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / a * w[i]
            zb, nb = zb + e - (math.sqrt(nb + e * e) - math.sqrt(nb)) / a * b, nb + e * e
    return {i: weight(i) for i in z}, -zb / ((beta + math.sqrt(nb)) / a)


def test_training_against_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 50, rng.integers(1, 20))) for _ in range(60)]
    values = [rng.random(len(r)) for r in rows]
    labels = rng.integers(0, 2, 60).astype(float)
    model = quality.train(list(zip(rows, values)), labels, float(labels.mean()), epochs=3)
    weights, bias = plain_ftrl([dict(zip(r.tolist(), v.tolist())) for r, v in zip(rows, values)], labels.tolist(), 3)
    assert model.intercept == pytest.approx(bias, abs=1e-9)
    assert all(model.weights[i] == pytest.approx(w, abs=1e-9) for i, w in weights.items())


def test_features_are_counts_of_ngrams():
    texts = ["Aa b! b! Aa", None, "", "b", "aA b! b! aA", "Aa b! b! Aa"]
    bounds, bucket, value = quality.features(Text.of_strings(texts))
    parts = [(bucket[a:b].tolist(), value[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    # Words Aa b ! b ! Aa: 3 kinds of words, 4 of pairs; shapes X b ! b ! X: 3, 4, 4.
    assert len(parts[0][0]) == 3 + 4 + 3 + 4 + 4 and parts[0] == parts[5] and parts[1] == parts[2] == ([], [])
    assert all(abs(sum(v * v for v in p[1]) - 1) < 1e-12 for p in parts if p[0])
    assert len(parts[3][0]) == 2 and len(set(parts[0][0]) & set(parts[4][0])) >= 7  # words agree in any case, shapes differ
    whole = quality.features(Text.of_strings([texts[0]]))
    assert whole[1].tolist() == parts[0][0]


def test_labels_missing_conflicting_and_repeated(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    assert quality.quality(docs.limit(0), none).count() == 0
    ids = [i for i in range(400)]
    rows = [(i, "clean plain words" if i % 2 else "noise $$$ %%% noise") for i in ids] + [(ids[0], "noise $$$ %%% noise")] * 3000
    labels = [(i, i % 2) for i in ids] + [(3, 0), (5, None), (None, 1)] + [(7, 1)] * 500
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(df, lab, per_class=50)
    s = model.score(Text.of_strings(["plain words", "some $$$ noise"]))
    assert s[0] > 0.5 > s[1]
    long = spark.createDataFrame([(i, t * 500) for i, t in rows[:400]], "doc_id long, text string")
    s = quality.fit(long, lab, sample_bytes=10).score(Text.of_strings(["plain words", "some $$$ noise"]))  # the first text of each class is larger
    assert s[0] > s[1]
