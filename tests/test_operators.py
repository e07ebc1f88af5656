"""Inline rows for branches the given tables don't reach, and streams against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import extraction as G
from ledgerloom.operators import kpis as K
from ledgerloom.operators import rules as R
from ledgerloom.operators import windows as W
from ledgerloom.sources import files, packs
from ledgerloom.streaming import outbox as O


def facts(spark, regime=None, facts=(), documents=(), pages=(), checks=()):
    return R.Facts(
        spark.createDataFrame([(1, regime)], "case_id long, regime string"),
        spark.createDataFrame(list(facts), "case_id long, key string, value string"),
        spark.createDataFrame(list(documents), "case_id long, doc_type string"),
        spark.createDataFrame(list(pages), "case_id long, page int, text string"),
        spark.createDataFrame(list(checks), "case_id long, kind string, status string"),
    )


@pytest.mark.parametrize(
    "rule, given, fires, evidence",
    [
        (R.Rule("a", "missing_evidence", required=("Guardian Court Permission",)), {"documents": [(1, "CNIC Copy")]}, True, None),
        (R.Rule("a", "missing_evidence", required=("sale deed",)), {"documents": [(1, "Certified Sale Deed copy")]}, False, None),
        (R.Rule("a", "missing_evidence"), {}, True, None),
        (R.Rule("a", "mismatch", pattern="cnic"), {"facts": [(1, "party.cnic", "35202-1234567-1"), (1, "party.cnic", "3520212345672")]}, True, "2"),
        (R.Rule("a", "mismatch", pattern="cnic"), {"facts": [(1, "party.cnic", "35202-1234567-1"), (1, "party.cnic", "3520212345671")]}, False, None),
        (R.Rule("a", "keyword_risk", keywords=("mortgage",)), {"pages": [(1, 1, "an existing Mortgage with XYZ")]}, True, "mortgage"),
        (R.Rule("a", "verification_check", kind="registry", keys=("registry.number",)), {"facts": [(1, "registry.number", "123")], "checks": [(1, "registry", "Verified")]}, False, None),
        (R.Rule("a", "verification_check", kind="registry", keys=("registry.number",)), {"facts": [(1, "registry.number", "123")], "checks": [(1, "registry", "Failed")]}, True, "failed"),
        (R.Rule("a", "constructed_gate", required=("map",)), {"facts": [(1, "property.constructed", "Yes")]}, True, None),
        (R.Rule("a", "constructed_gate", required=("map",)), {}, False, None),
        (R.Rule("a", "timeline_gap"), {}, False, None),
        (R.Rule("a", "missing_evidence", conditional="if regime == RUDA"), {}, False, None),
        (R.Rule("a", "missing_evidence", conditional="if regime == RUDA"), {"regime": "RUDA"}, True, None),
    ],
)
def test_rules(spark, rule, given, fires, evidence):
    got = R.evaluate([rule], facts(spark, **given)).collect()
    assert bool(got) == fires and (not fires or got[0].evidence == evidence or evidence is None)


def test_regimes(spark):
    want = {"DHA Phase 6": "DHA", "lahore development auth": "UNKNOWN", "lahore development authority": "LDA", "": None, None: None, "TMA city": "MUNICIPAL", "CB Lahore": "CANTONMENT", "LDA / DHA": "LDA", "Housing scheme": "UNKNOWN", "Cantt": "UNKNOWN", "mc": "MUNICIPAL", " society ": "SOCIETY"}
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r.v: r.n for r in df.select("v", R.normalized_regime(F.col("v")).alias("n")).collect()} == want


def test_classified_regime(spark):
    cases = spark.createDataFrame([(1, None, None), (2, "DHA", "LDA town"), (3, "none", "both lda and dha"), (4, None, None), (5, "", None)], "case_id long, regime string, scheme string")
    docs = spark.createDataFrame([(1, "Mutation", "x.pdf"), (1, "old mutation", "y"), (2, "fard", None), (4, None, "Ruda.pdf")], "case_id long, doc_type string, filename string")
    pages = spark.createDataFrame([(3, "a mouza"), (4, "society membership"), (5, "ends in cb"), (1, None)], "case_id long, text string")
    got = lambda **k: {r.case_id: (r.regime, r.score) for r in R.classified_regime(cases, docs, pages, **k).collect()}
    assert got() == {1: ("REVENUE", 0.9), 2: ("DHA", 0.9), 3: ("DHA", 0.85), 4: ("RUDA", 0.9), 5: ("CANTONMENT", 0.8)}
    assert got(overwrite=True)[2] == ("REVENUE", 0.9)


def test_packs(spark, tmp_path):
    rules, errors = R.validated(packs.rule_list(packs.HOME / "rules.yaml"))
    assert [r.id for r in rules] == ["ID-1", "TI-1", "TI-2", "TI-3", "AU-1", "AU-2", "AU-3"] and len(errors) == 5
    assert rules[1].keywords == ("token", "license") and rules[2].keywords == ("the",) and rules[5].evaluator == "missing_evidence"
    for name, text in (("list", "- a"), ("broken", "a: [b"), ("wrong", "rules: 5"), ("empty", "")):
        (tmp_path / name).write_text(text)
        assert packs.rule_list(tmp_path / name) == []
    assert packs.rule_list(tmp_path / "missing") == [] and packs.evidence_library(spark, tmp_path / "empty").count() == 0
    assert packs.playbooks(spark, packs.HOME / "playbooks.yaml").count() == 3


def test_keyword_references(spark):
    f = facts(spark, pages=[(1, 1, "Token and LICENSE"), (1, 2, "a license"), (1, 3, None), (2, 1, "token")])
    got = R.keyword_references(R.Rule("K", "keyword_risk", keywords=("license", "token")), f).orderBy("page").collect()
    assert [(r.page, r.note) for r in got] == [(1, "Contains keyword: license"), (2, "Contains keyword: license")]


def test_gates(spark):
    df = spark.createDataFrame(
        [("party.cnic", "CNIC: 35202 1234567 1", "35202-1234567-1"), ("execution.date", "12/01/2022", "2022-01-12"), ("execution.date", "29/02/2023", "2023-02-29"), ("execution.date", "31/04/2022", None), ("amount", "Rs 15,600,000", "15600000"), ("amount", "500", None), ("amount", "Rs 500", "500"), ("plot", "Com-14", "14-Com"), ("title", " x ", "x"), ("title", "  ", None)],
        "k string, v string, want string",
    )
    assert [r for r in df.withColumn("got", G.gate(F.col("k"), F.col("v"))["value"]).collect() if r.got != r.want] == []


def test_text_repair(spark):
    urdu = "کاشف زابد"
    broken = urdu.encode().decode("latin-1")
    df = spark.createDataFrame([(broken,), ("plain",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(X.repair("v")).collect()] == [urdu, "plain", None, ""]
    assert df.limit(1).select(X.mojibake(F.lit("┌⌐╪º╪┤"))["corrupted"]).first()[0]
    assert spark.range(1).select(X.ascii_digits(F.lit("۱۲٣"))).first()[0] == "123"
    assert X.repaired("x") == "x"


def test_golden_matching(spark):
    schema = "case_id long, id long, rule_id string, title string, text string"
    e = [(1, 1, "R1", "alpha beta gamma", ""), (1, 2, None, "alpha beta delta", ""), (1, 3, None, "nothing like it", ""), (2, 4, None, "only expected", None), (4, 6, None, "one two three four", None), (4, 7, "", "aaa bbb ccc", "long text of words")]
    a = [(1, 1, "R9", "alpha beta delta", ""), (1, 2, "R1", "other words here", ""), (1, 3, "R7", "zzz yyy", ""), (3, 5, "R1", "only found", None), (4, 8, "", "one five six seven eight nine", None), (4, 9, "", "bbb", "long text of words"), (4, 10, None, "aaa bbb ccc", None)]
    got = E.golden_matching(spark.createDataFrame(e, schema), spark.createDataFrame(a, schema)).collect()
    rows = sorted((r.case_id, r.status, r.expected_id or 0, r.actual_id or 0, round(r.similarity, 3)) for r in got)
    assert rows == [
        (1, "extra", 0, 3, 0.0), (1, "matched", 1, 2, 1.0), (1, "matched", 2, 1, 1.0), (1, "missed", 3, 0, 0.0), (2, "missed", 4, 0, 0.0), (3, "extra", 0, 5, 0.0),
        (4, "extra", 0, 8, 0.0), (4, "extra", 0, 9, 0.0), (4, "matched", 7, 10, 1.0), (4, "missed", 6, 0, 0.0),
    ]
    m = E.run_metrics(E.golden_matching(spark.createDataFrame(e, schema), spark.createDataFrame(a, schema)), spark.createDataFrame([(1, 3)], "case_id long, expected_id long"))
    by = {r.case_id: r for r in m.collect()}
    assert (by[1].critical_recall, by[1].overall_recall, by[1].precision) == (0.0, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert (by[3].critical_recall, by[3].overall_recall, by[3].precision) == (None, None, 0.0) and by[2].precision is None


def test_autofill_overwrites_only_if_told(spark):
    rows = [(1, "title", "new", 0.9, 0, "good"), (1, "party.cnic", "35202 1234567 1", 0.7, 1, "fair"), (1, "party.cnic", "123", 0.6, 0, "good"), (2, "party.name", "Ali Khan of the property", 0.9, 0, "good"), (2, "title", "t", 0.5, 0, "poor")]
    c = spark.createDataFrame(rows, "case_id long, field string, value string, confidence double, ord int, quality string")
    d = spark.createDataFrame([(1, "title", "old"), (2, "title", " ")], "case_id long, field string, value string")
    got = lambda **k: {(r.case_id, r.field): (r.value, r.confidence and round(r.confidence, 3), r.status) for r in G.autofill(c, d, **k).collect()}
    assert got() == {(1, "title"): ("old", None, "kept"), (1, "party.cnic"): ("35202-1234567-1", 0.56, "needs_review"), (2, "title"): ("t", 0.2, "needs_review")}
    assert got(overwrite=True)[1, "title"] == ("new", 0.9, "extracted")


def test_error_rates(spark):
    df = spark.createDataFrame([("", ""), ("x", ""), ("abc", "abd"), ("فرد", "فرد")], "p string, g string")
    assert [r[0] for r in df.select(E.cer(F.col("p"), F.col("g"))).collect()] == [0.0, 1.0, pytest.approx(1 / 3), 0.0]
    assert [r[0] for r in df.select(E.overlap_f1(F.col("p"), F.col("g"))).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_empty_kpis(spark):
    none = spark.createDataFrame([], "status string, day date")
    assert sorted(map(tuple, K.zero_filled(none, "status", ["a", "b"], "n").collect())) == [("a", 0), ("b", 0)]
    assert K.daily({"n": (none, "day")}, dt.date(2024, 1, 3), 3).count() == 3
    assert none.agg(K.pct(F.count("*"), F.count("*")).alias("p")).first().p == 100.0


def test_upsert_and_islands(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, W.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    runs = spark.createDataFrame([(1, i, v) for i, v in enumerate(["x", "x", None, None, "x"])], "k int, i int, v string")
    assert [r.run for r in W.islands(runs, ["k"], ["i"], F.col("v")).orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filename,actual_type,text\na.pdf,deed,some text\n")
    (tmp_path / "b.txt").write_text("hello\nworld")
    (tmp_path / "m.json").write_text('{"items": [{"id": "x", "pages": [{"page": 1, "gt_path": "p"}]}]}')
    assert files.csv_labels(spark, str(tmp_path / "a.csv")).first().actual_type == "deed"
    assert tuple(files.text_folder(spark, str(tmp_path)).first()) == ("b", "hello\nworld")
    assert tuple(files.manifest(spark, str(tmp_path / "m.json")).first()) == ("x", 1, "p")
    df = spark.createDataFrame([(1, "one\ftwo")], "id int, text string")
    assert [r.page_text for r in files.paged(df, "text").collect()] == ["one", "two"]
    files.to_csv(df, str(tmp_path / "out"))
    files.append(df, str(tmp_path / "log"))
    files.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 and "one" in files.to_report(df, str(tmp_path / "r"))


def test_folder_labels(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name, text in (("a b/x.pdf", "%"), ("a b/x.txt", "one\ntwo"), ("x.pdf", "%"), ("y.txt", "lone")):
        (tmp_path / name).write_text(text)
    got = sorted(map(tuple, files.folder_labels(spark, str(tmp_path)).collect()))
    assert got == [("x.pdf", "", ""), ("x.pdf", "", "one\ntwo")]


def drained(query_df, spark, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    twice = events.unionByName(events.limit(50)).withColumn("ts", F.col("ts").cast("timestamp"))
    twice.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    source = O.stream(spark, str(tmp_path / "in"), twice.schema)
    once = drained(O.deduplicated(source), spark, "once", "append")
    assert once.count() == events.count()
    daily = drained(O.daily_counts(source), spark, "daily", "complete")
    assert daily.agg(F.sum("n")).first()[0] == events.count() + 50
    failing = source.select("event_id", (F.col("event_id") % 2 == 0).alias("failed"))
    last = drained(O.retries(failing), spark, "retries", "update")
    assert {(r.attempts, r.status) for r in last.where("event_id % 2 = 1").collect()} == {(0, "Done")}


def test_retry_states():
    s = (0, "Pending")
    for _ in range(6):
        s = O.next_state(*s, failed=True)
    assert s == (5, "Failed") and O.next_state(2, "Pending", False) == (2, "Done")
