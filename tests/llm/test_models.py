"""Held-out accuracy and odd rows of the trained operators: language ID and toxicity."""

import numpy as np

from ledgerloom.llm import langid, toxicity
from ledgerloom.llm.kernel import Text

SF = "/root/testdata/sf0.01"
ODD = [(-1, None), (-2, ""), (-3, "12 34 !?"), (-4, "the the the"), (-4, "the the the"), (-5, "— … ×"), (-6, "a" * 50_000)]


def test_language_of_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.unionByName(spark.createDataFrame([(d, t, None) for d, t in ODD], "doc_id long, text string, lang string"))
    got = langid.identify(rows).collect()
    assert len(got) == rows.count()
    true = {r.doc_id: r.lang for r in docs.collect()}
    test = [r for r in got if r.held_out and r.doc_id in true]
    assert np.mean([r.lang_pred == true[r.doc_id] for r in test]) > 0.98
    odd = {r.doc_id: r for r in got if r.doc_id < 0}
    assert {d for d in odd if odd[d].lang_pred == "und"} == {-1, -2, -3, -5} and odd[-4].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    pure = {r.lang: r.text for r in docs.where("lang IN ('en', 'de') AND n_chars > 1500").collect()}
    both = pure["en"][:1500] + " " + pure["de"][:700]
    lang, score, theta = model.predict(Text.of_strings([both]))
    mix = dict(zip(model.languages, theta[0]))
    assert lang == ["en"] and 0.5 < mix["en"] < 0.85 and mix["de"] > 0.15 and mix["fr"] < 0.05


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0


def test_toxicity_of_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    got = toxicity.toxicity(rows, labels).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
    true = {r.doc_id: r.toxic for r in labels.collect()}
    test = [(r.predicted, true[r.doc_id]) for r in got if r.held_out and r.doc_id in true]
    p = np.array(test)
    assert p[p[:, 1] == 1, 0].mean() > 0.6 and p[p[:, 1] == 0, 0].mean() < 0.01


def test_toxicity_without_labels_and_misspellings(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, none).count() == 2
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abdegiklmnoprstu"), 6)) for _ in range(300)]
    texts, y = [], []
    for i in range(600):
        w = list(rng.choice(words, 40))
        if i % 3 == 0:
            w[rng.integers(40)] = rng.choice(["horriblezz", "horriblezzing", "xhorriblezz"])
        texts.append(" ".join(w))
        y.append(float(i % 3 == 0))
    model = toxicity.train(texts, np.array(y), 1 / 3)
    s = model.score(Text.of_strings(["oh horriblezzed thing", "oh harmless thing"]))
    assert s[0] > 0.5 > s[1]


def test_toxicity_with_a_text_larger_than_the_sample(spark):
    rows = [(k, ("nice harmless words here", "awful horriblezz words here")[k % 2], k % 2) for k in range(200)]
    train = lambda extra: toxicity.fit(*(spark.createDataFrame(rows + extra, "doc_id long, text string, toxic int").select(*c) for c in (("doc_id", "text"), ("doc_id", "toxic"))), sample_bytes=20_000)
    probe = Text.of_strings(["awful horriblezz words", "nice harmless words"])
    extra = [(k, "long horriblezz text " * 2000, 1) for k in range(1000, 1100)]  # wherever their hashes fall
    s = train(extra).score(probe)
    assert s[0] > 0.5 > s[1]
    rows = [r for r in rows if r[2] == 0]
    s = train(extra).score(probe)  # toxic texts that are all larger than the sample
    assert s[0] > s[1]
    assert toxicity.fitting([5, 99, 5, 1], 10) == [True, False, True, False] and toxicity.fitting([99, 98], 10) == [True, False]


def test_toxicity_candidates_are_one_an_id(spark):
    rows = [(1, f"text {k}") for k in range(3000)] + [(2, "a"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([(1, 1)] * 500 + [(1, 0), (2, 0), (3, 1)], "doc_id long, y int")
    got = sorted((r.doc_id, r.y, r.size) for r in toxicity.candidates(docs, marked, {0: 1.0, 1: 1.0}).collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (2, 0)] and got[0][2] == got[1][2]
    model = toxicity.fit(docs, marked.withColumnRenamed("y", "toxic"))
    assert 0 < model.score(Text.of_strings(["a"]))[0] < 1


def test_very_many_languages(spark):
    from pyspark.sql import functions as F

    many = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    some = spark.range(10_000, 10_400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the cat and the dog").otherwise("der hund und die katze").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    docs = many.unionByName(some)
    model = langid.fit(docs)
    assert len(model.languages) == langid.MOST_LANGUAGES and {"en", "de"} <= set(model.languages)
    lang, _, _ = model.predict(Text.of_strings(["the dog and the cat", "die katze und der hund"]))
    assert lang == ["en", "de"]
