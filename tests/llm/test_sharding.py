import zlib
from collections import Counter

import pytest

from ledgerloom.llm import sharding as S


def test_law_slots_sizes(spark):
    rows = [(i, f"text {i} é" * (i % 7)) for i in range(3000)] + [(5000, None), (None, "x"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.shard(df, 40, rows_per_bucket=10).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 40 and 0 <= r.grown_shard <= 40
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by = {r.doc_id: r for r in got}
    assert (by[5000].size, by[5000].text_crc32) == (16, 0)
    assert by[8].size == len(rows[8][1].encode()) + 16 and by[8].text_crc32 == zlib.crc32(rows[8][1].encode())
    moved = sum(r.grown_shard != r.shard for r in got) / len(got)
    assert 0.01 < moved < 0.05
    direct = S.shard(df, 41, rows_per_bucket=10_000).collect()
    assert Counter((r.doc_id, r.grown_shard) for r in got) == Counter((r.doc_id, r.shard) for r in direct)


def test_weights(spark):
    df = spark.range(8000).selectExpr("id AS doc_id", "'t' AS text", "1 AS shard", "'x' AS law")
    n = Counter(r.shard for r in S.shard(df, 4, weights=[1, 1, 2, 4]).collect())
    for s, share in enumerate((1 / 8, 1 / 8, 2 / 8, 4 / 8)):
        assert abs(n[s] / 8000 - share) < 0.02
    a = {r.doc_id: r.shard for r in S.shard(df, 4, weights=[1, 1, 2, 4]).collect()}
    b = {r.doc_id: r.shard for r in S.shard(df, 4, weights=[1, 1, 2, 5]).collect()}
    assert all(b[k] in (a[k], 3) for k in a)
    with pytest.raises(ValueError):
        S.shard(df, 2, weights=[1, 0])


def test_no_python_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = S.shard(df)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
