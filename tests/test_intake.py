"""What comes in: name lines, spans and engines on hand-made rows, and that the given tables reach every outcome."""

from ledgerloom import registry
from ledgerloom.operators import doctypes as D
from ledgerloom.operators import extraction as E

SF = "/root/testdata/sf0.01"


def test_name_lines(spark):
    want = {
        "Muhammad Aslam Khan": (True, 1.05, "proper_case"), "Md Al Khan": (True, 1.05, "has_short_tokens,proper_case"), "M. A. Khan": (False, None, "low_alpha_ratio"), "A B Khan": (False, None, "has_stopword"), "K B C Khan": (True, 0.85, "many_initials,proper_case"), "K B C D E": (False, 0.65, "low_score,many_initials,proper_case"),
        "ali raza": (True, 1.0, ""), "Ali": (False, None, "bad_token_count"), "owner of the plot": (False, None, "has_stopword"), "He certifies it": (False, None, "has_sentence_verb"), "Ali Khan 35": (False, None, "has_digits,low_alpha_ratio"),
        "Ali Khan, s/o Bashir": (True, 1.0, ""), "Ali, and Khan": (False, None, "has_comma,has_stopword"), "Seller: Ali Khan": (False, None, "has_sentence_punct"), "x" * 61 + " y": (False, None, "too_long"), "Ali *** (Khan)": (False, None, "low_alpha_ratio"), "کاشف زابد": (True, 1.0, ""),
    }
    df = spark.createDataFrame([(i, f"  {x}\t") for i, x in enumerate([*want, "", " "])], "i int, line string")
    got = {r.line: (r.accepted, r.score, r.flags) for r in E.scored_name_lines(df, ["i"]).collect()}
    assert got == want


def test_spans(spark):
    rows = [(1, 0, 0, "Ali", "B-PERSON_NAME", 0.9), (1, 0, 1, "Ali", "O", 0.9), (1, 1, 2, "Khan", "I-PERSON_NAME", 0.4), (1, 2, 3, "x", "O", 0.9), (1, 3, 4, "352", "B-CNIC", 0.65), (1, 5, 5, "1999", "DATE", 0.6), (1, 7, 6, "2000", "DATE", 0.7), (1, 8, 7, "a║b", "AMOUNT", 0.9), (1, 9, 8, "s", "STAMP", 0.9)]
    df = spark.createDataFrame(rows, "page long, word_no long, token_no long, word string, label string, confidence double")
    got = lambda **k: sorted((r.label, r.value, r.first, r.size, round(r.confidence, 3), r.low) for r in E.token_spans(df, "page", **k).collect())
    sure = [("DATE", "1999", 5, 1, 0.6, False), ("DATE", "2000", 7, 1, 0.7, False), ("PERSON_NAME", "Ali Khan", 0, 2, 0.65, False)]  # a missing word ends a span
    assert got() == sure and got(keep_low=True) == sorted([*sure, ("CNIC", "352", 3, 1, 0.65, True)])


def test_engines(spark):
    rows = [(1, "primary", 0.9, 50), (1, "fallback", 0.99, 50), (2, "primary", 0.5, 50), (2, "fallback", 0.5, 51), (3, "primary", 0.9, 9), (3, "fallback", 0.8, 99), (4, "primary", 0.1, 1), (4, "text_only", 0.2, 3), (5, "primary", 0.4, 50), (5, "fallback", 0.6, 20), (5, "text_only", 0.9, 90)]
    df = spark.createDataFrame(rows, "page long, engine string, confidence double, words int")
    assert {r.page: (r.engine, r.used_fallback) for r in E.chosen_engine(df, "page").collect()} == {1: ("primary", False), 2: ("fallback", True), 3: ("primary", False), 4: ("text_only", True), 5: ("fallback", True)}


def test_given_tables_reach_every_case(spark):
    run = lambda name: registry.QUERIES[name](spark, SF)
    assert {r.v for r in run("R02b_filename_types").select("v").distinct().collect()} >= {kind for _, kind in D.FILENAME_TYPES} - {"lda_layout_plan", "stamp_receipt"} | {None}
    assert {(r.engine) for r in run("C03b_engine_routing").select("engine").distinct().collect()} == {"primary", "fallback", "text_only"}
    assert {r.origin for r in run("S16b_effective_page_text").select("origin").distinct().collect()} == {"correction", "repaired", "ocr"}
    assert {r.label for r in run("C04b_entity_spans").select("label").distinct().collect()} == {"CNIC", "DATE", "AMOUNT"}
    parts = {r.part: r["count"] for r in run("S25b_seeded_split").groupBy("part").count().collect()}
    assert 0.86 < parts["train"] / sum(parts.values()) < 0.94
    assert {r.kind for r in run("K05b_due_schedules").collect()} == {"daily", "weekly"}
    assert {r.accepted for r in run("X09b_scored_name_lines").select("accepted").distinct().collect()} == {True, False}
