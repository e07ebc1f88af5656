"""Queries without SQL take every row of their tables."""

from ledgerloom import registry


def test_golden_matching_places_every_part(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["E01_golden_matching"](spark, sf).collect()
    ids = [r.expected_id for r in got if r.expected_id is not None] + [r.actual_id for r in got if r.actual_id is not None]
    assert sorted(ids) == sorted(r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect())
    assert all(r.case_id == i // 40 for r in got for i in (r.expected_id, r.actual_id) if i is not None)
