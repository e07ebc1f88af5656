"""Rows that every operator must take: empty tables, missing ids, clashing columns, words that fool linear hashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, kernel, langid, near_dedup, packing, periodic, pii, pitman_yor, quality, spotsigs, suffix_dedup, toxicity

ROWS = [(None, "some words without an id", "en"), (None, "some words without an id", "en"), (1, None, "en"), (2, "", None), (3, "a few other words here", "fr"), (3, "a few other words here", "fr")]


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["score", "kept", "block", "h", "row", "start", "n_shingles", "pii", "part", "hits", "by", "toxicity", "g"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("doc_id", "text", "lang", *[F.lit(f"own {c}").alias(c) for c in clash]).cache()


def runs(name, docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "few other")], "item_id long, text string")
    return {
        "decontaminate": lambda d: decontaminate.summary(decontaminate.find(d, items)),
        "langid": langid.identify,
        "near_dedup": near_dedup.near_duplicates,
        "packing": packing.pack,
        "periodic": periodic.find,
        "pii": lambda d: pii.summary(pii.find(d)),
        "pitman_yor": pitman_yor.score,
        "quality": lambda d: quality.quality(d, spark.createDataFrame([], "doc_id long, quality int")),
        "spotsigs": spotsigs.neighbours,
        "suffix_dedup": suffix_dedup.dedupe,
        "toxicity": lambda d: toxicity.toxicity(d, none),
    }[name](docs)


NAMES = ["decontaminate", "langid", "near_dedup", "packing", "periodic", "pii", "pitman_yor", "quality", "spotsigs", "suffix_dedup", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, docs, name):
    got = [r.doc_id for r in runs(name, docs, spark).collect()]
    if name == "packing":  # a row for each piece
        assert set(got) == {None, 1, 2, 3}
    else:
        assert sorted(got, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, name):
    assert runs(name, docs.limit(0), spark).count() == 0


def test_clean_keeps_columns(spark, docs):
    for clean in (langid.keep_known, near_dedup.keep_one, pii.redact, lambda d: decontaminate.clean(d, spark.createDataFrame([], "item_id long, text string"))):
        assert clean(docs).columns == docs.columns


def test_hashes_tell_structured_strings_apart():
    for n in (1024, 2048, 4096):
        a, b = thue_morse(n)
        h = kernel.Text.of_strings([a, b, a]).words(kernel.NOT_SPACE)[0]
        assert h[0] == h[2] != h[1]
        w = [kernel.windows(np.frombuffer(x.encode(), np.uint8), (n,))[0][0] for x in (a, b)]
        assert w[0] != w[1]
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 70_000).astype(np.uint8)
    for n in (5, 8, 20, 400):
        h = kernel.windows(data, (n,))[0]
        seen: dict = {}
        for i in rng.integers(0, len(h), 3000).tolist() + list(range(32_700, 32_800)):
            assert seen.setdefault(data[i : i + n].tobytes(), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


def test_counts_and_tokens_of_structured_words(spark):
    a, b = thue_morse(1024)
    df = spark.createDataFrame([(k, f"x {w} y") for k, w in enumerate([a, a, b, a] * 3)], "doc_id long, text string")
    got = {r.doc_id: r.base_score for r in pitman_yor.score(df).collect()}
    assert got[0] == pytest.approx(got[1]) and got[0] != pytest.approx(got[2])
    from tokenizers import Tokenizer

    tok, text = Tokenizer.from_file(packing.default_tokenizer()), f"{a} {b}"
    ids = [x for r in sorted(packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), ids=True).collect(), key=lambda r: r.start) for x in r.ids]
    assert ids[:-1] == tok.encode(text, add_special_tokens=False).ids


def test_toxicity_equals_a_plain_form():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -0.3)
    texts = ["Some Words, and more words: to_score", "one", "", "... ---", "é x " * 7, "a b c d e f g"]

    def word(w):
        t = kernel.Text.of_strings([f"<{w}>"])
        raw, at = t.data, []
        for n in toxicity.ORDERS:
            for i in range(len(raw) - n + 1):
                h = t.hashes(np.array([i]), np.array([i + n]), fold=False)
                at.append(int(kernel.mix(h + kernel.U64(n))[0] >> kernel.U64(64 - toxicity.BITS)))
        at.append(int(t.hashes(np.array([0]), np.array([len(raw)]), fold=False)[0] >> kernel.U64(64 - toxicity.BITS)))
        return float(np.mean(model.rows[at]))

    def plain(t):
        words = [w.lower() for w in __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
        values = [np.mean([word(w) for w in words[i : i + toxicity.PASSAGE]]) for i in range(0, len(words), toxicity.PASSAGE)]
        return 1 / (1 + np.exp(-(max(values) if values else 0.0) - model.intercept))

    with np.errstate(over="ignore"):
        assert np.allclose(model.score(kernel.Text.of_strings(texts)), [plain(t) for t in texts], atol=1e-5)


def test_language_mixture_equals_plain_em():
    rng = np.random.default_rng(5)
    lik, times = rng.uniform(0.01, 1, (9, 3)), rng.integers(1, 5, 9).astype(float)
    model = langid.Model(["x", "y", "z"], rng.integers(0, 50, (3, 1 << langid.BITS)).astype(float))
    theta = model.mixture(lik, times, np.array([0, 9]))[0]
    live = theta > 0
    assert theta.sum() == pytest.approx(1) and live.any()

    def em(keep, rounds=4000):
        t = np.where(keep, 1 / keep.sum(), 0.0)
        for _ in range(rounds):
            r = lik * t
            t = (times[:, None] * r / r.sum(axis=1, keepdims=True)).sum(axis=0) / times.sum()
        return t

    assert np.allclose(em(live), theta, atol=0.05)


def test_added_spans_equal_a_plain_form():
    model = pii.trained()
    texts = ["call (212) 555-0199 now or write jane.doe [at] mail [dot] com, fe80::1:2:3:4 and 4111 1111 1111 1111", "no data", "10.0.0.1 or 10 . 0 . 0 . 1"]
    for t, got in zip(texts, pii.spans_of(texts, model)):
        base = pii.base_spans(t)
        free = [c for c in pii.candidates(t) if all(c[2] <= s or e <= c[1] for _, s, e in base)]
        scored = [(model.probability(np.array([pii.features(t, *c)]))[0], c) for c in free]
        taken, added = list(base), []
        for q, c in sorted((x for x in scored if x[0] >= model.threshold[x[1][0]]), key=lambda x: (-x[0], x[1][1], x[1][2])):
            if all(c[2] <= s or e <= c[1] for _, s, e in taken):
                taken.append(c)
                added.append(c)
        assert sorted(s[:3] for s in got if not s[4]) == sorted(added) and sorted(s[:3] for s in got if s[4]) == sorted(base)
