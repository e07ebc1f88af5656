import importlib

import pytest

import corpus_pipeline as C
from ledgerloom.llm import decontaminate, langid, near_dedup, packing, pii

from .test_decontaminate import words
from .test_near_dedup import brute
from .test_pii import brute as base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in C.STAGES:
        out.append(C.written(f(spark, out[-1], SF), "test-stage"))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language", "near_dedup", "decontaminate", "pii", "pack"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_language_keeps_what_has_letters(stages):
    before = {r.doc_id: r for r in stages[0].collect()}
    after = {r.doc_id: r for r in stages[1].collect()}
    assert set(after) == {d for d, r in before.items() if any(c.isalpha() for c in r.text or "")}
    assert sum(after[d].lang == before[d].lang for d in after) >= 0.98 * len(after)


def test_near_dedup_equals_brute_force(stages):
    want = {r[0] for r in brute([(r.doc_id, r.text) for r in stages[1].collect()], 5) if r[3]}
    assert {r.doc_id for r in stages[2].collect()} == want


def test_decontamination_equals_brute_force(spark, stages):
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = set()
    for r in stages[2].collect():
        w = words(r.text)
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in stages[3].collect()} == clean and len(clean) < stages[2].count()


def test_pii_is_gone_and_nothing_else(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for d, t in before.items():
        assert not base_spans(after[d].text) and after[d].n_chars == len(after[d].text)
        if not base_spans(t) and not pii.candidates(t):
            assert after[d].text == t


def test_packed_ids_cover_all_tokens(spark, stages):
    assert stages[5].groupBy("doc_id").sum("length").count() == stages[4].count()
    assert stages[5].selectExpr("sum(length)").first()[0] == packing.pack(stages[4].coalesce(1)).selectExpr("sum(length)").first()[0]
    got = C.run(spark, SF)
    assert got.columns == stages[5].columns and got.count() == stages[5].count()


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123 456", "en", "s", 7), (4, "hello there my friend of old", None, "s", 5), (4, "hello there my friend of old", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for f in (langid.keep_known, near_dedup.keep_one, pii.redact):
        out = f(docs)
        assert out.columns == docs.columns
        out.collect()
        assert f(docs.limit(0)).count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.clean(docs, bench).count() == 5
    assert importlib.reload(C).ORACLE_SQL is None
