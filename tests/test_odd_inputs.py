"""Documents that the given tables don't have: very long lines, empty texts, shares and means that lie between two rounded values."""

import duckdb
from pyspark.sql import functions as F

from ledgerloom import registry
from ledgerloom.operators import extraction as E
from ledgerloom.operators import parties as P


def both(spark, tmp_path, name, rows, schema, table="documents"):
    """Rows of Spark and of DuckDB over one table, as text."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, want))


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_name_lines_of_very_many_words(spark):
    lines = ["Ab " * 200_000 + "Cd", "Ab" + " Cd" * 100_000 + ", son of X", "Ab" + " Cd" * 100_000 + ", aunt of X", "Ali Raza, s/o Bilal", "Ali K, s/o Bilal", "Ali Raza , s/o Bilal", "ali  raza,son"]
    got = {r.n: r.flags.split(",") for r in E.scored_name_lines(spark.createDataFrame(list(enumerate(lines)), "n int, line string"), ["n"]).collect()}
    assert ["has_comma" in got[i] for i in range(7)] == [False, False, True, False, True, True, False]


def texts(*texts):
    return [(i, x, "en", "web", None if x is None else len(x)) for i, x in enumerate(texts)]


def test_ratios_of_empty_texts_and_between_rounded_values(spark, tmp_path):
    got, want = both(spark, tmp_path, "T22_ratios", texts("", None, "7" * 41 + "x" * 599, "a" * 333 + "-" * 307, "x. " * 30), DOCUMENT)
    assert got == want and any("0.064062" in r for r in got) and any("nan" in r for r in got)


def test_mojibake_of_empty_texts_and_between_rounded_values(spark, tmp_path):
    got, want = both(spark, tmp_path, "T02_mojibake", texts("", None, "\u2500" * 41 + "x" * 599, "\u00ba" + "y" * 99, "plain", "\x01"), DOCUMENT)
    assert got == want and any("0.064062" in r for r in got) and "(0, 0, nan, True)" in got


def test_report_of_means_between_printed_values_and_unknown_languages(spark, tmp_path):
    rows = [(i, "x", "en", "web", 1000 if i < 1 else 7) for i in range(32)] + [(i, "x", "de", "web", 1001 if i < 3 else 8) for i in range(160)]
    rows += [(1, "x", None, "web", 5), (2, "x", "en", None, 5), (3, "x", "fr", "", 5), (4, "x", "", "source", 2000)]
    got, want = both(spark, tmp_path, "S19b_written_report", rows, DOCUMENT)
    assert got == want and any("38.0312" in r for r in got)


def test_a_name_is_cleaned_once_however_often_it_is_used(spark):
    x = spark.createDataFrame([("between Ali Raza s/o Y (hereinafter called vendor) and Sara Bibi ولد X (hereinafter called vendee)",)], "text string").select(P.vendor_and_vendee(F.col("text")).alias("v"))
    assert x._jdf.queryExecution().analyzed().expressions().toString().count("regexp_extract") <= 2
    assert tuple(x.first().v) == ("Ali Raza", "Sara Bibi")


def test_a_line_is_cleaned_once_for_its_score_and_its_words(spark):
    x = spark.createDataFrame([("Ali Raza Khan",), ("it is hereby agreed",), (None,), ("کاشف زابد",)], "line string").select(P.is_name(F.col("line")).alias("v"))
    assert x._jdf.queryExecution().analyzed().expressions().toString().count("{2,}") <= 3  # the line's, and two tests of words
    assert [r.v for r in x.collect()] == [True, False, False, True]


def test_deeds_of_one_small_file_are_dealt_to_all_cores(spark):
    df = registry.QUERIES["X10b_domain_hint_rows"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_boxes_that_begin_half_way_between_two_numbers(spark, tmp_path):
    boxes = [(page, 5, line, 1000.0 * page + x, q) for page in (1, 2) for line, x, q in ((9, 234.5, 10.0), (3, 234.9, 20.0), (4, 235.5, 7.5), (2, 236.1, 7.0), (5, 0.5, 1.0))]
    got, want = both(spark, tmp_path, "W12b_row_clusters", boxes, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_quantity double", "lineitem")
    assert got == want
