"""Whitening against a dense eigenproblem, exact deviations, breakdown and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def dense(vectors):
    """(x, S, eigenvalues, eigenvectors, trace) in plain numpy."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    y = x - x.mean(axis=0)
    cov = y.T @ y / len(x)
    value, axes = np.linalg.eigh(cov)
    return x, x.sum(axis=0), value[::-1], axes[:, ::-1], np.trace(cov)


def test_query_against_dense(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.QUERIES["op11_whiten"](spark, SF).toPandas()
    x, sums, value, axes, trace = dense([r.embedding for r in data])
    n = len(x)
    assert len(got) == n * 32 and set(got.n) == {n} and got.groupby("vec_id").component.apply(sorted).map(lambda c: c == [*range(1, 33)]).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    want = {r.vec_id: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for r, row in zip(data, x)}
    assert all(d == want[v] for v, d in zip(got.vec_id, got.deviation))
    z = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in data]].to_numpy()
    ours = (x - x.mean(axis=0)) @ (axes[:, :32] / np.sqrt(value[:32]))
    assert np.abs(np.abs(z) - np.abs(ours)).max() < 1e-8
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.abs(explained - value[:32] / trace).max() < 1e-12


def test_lanczos_breakdown_multiplicity_and_convergence():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    passes = []

    def run(value, k, block):
        a = q * value @ q.T
        passes.clear()
        got, axes = whitening.lanczos(lambda v: passes.append(v.shape[1]) or a @ v, len(value), k, block)
        assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13
        assert np.abs(got - np.sort(value)[::-1][:k]).max() < 1e-9 * value.max()
        assert np.linalg.norm(a @ axes - axes * got, axis=0).max() < 1e-9 * value.max()

    run(2.0 ** -np.arange(200), 10, 8)
    assert sum(passes) < 200  # converged before the basis was full
    run(np.concatenate([np.full(30, 5.0), np.full(170, 1.0)]), 40, 8)  # two eigenvalues: the first block breaks down at once
    run(np.concatenate([np.full(3, 7.0), np.zeros(197)]), 5, 4)
    run(1 + rng.random(200), 32, 16)


def test_rank_deficient(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-40, 40, (120, 3))
    flat = np.concatenate([base, base[:, :1] + base[:, 1:2], np.full((120, 2), 7)], axis=1) / 64  # rank 3 in 6 dimensions
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(flat)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).toPandas()
    assert sorted(set(got.component)) == [1, 2, 3] and abs(got.groupby("component").explained.first().sum() - 1) < 1e-9
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(z.T @ z / len(z) - np.eye(3)).max() < 1e-9 and got.identity_error[0] < 1e-9


ODD = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (2, [0.25, -1.0]), (None, [3.0, 0.1]), (4, None), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [-float("inf"), 0.0]), (9, []), (10, [1.0]), (11, [1e300, 0.0])]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumn("component", F.lit("own")).withColumn("n", F.lit(0))
    rows = whitening.whiten(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in rows) == sorted((v, c) for v in ("1", "2", "2", "None") for c in (1, 2))
    assert all(r.n == 4 for r in rows) and len({(r.vec_id, r.component, r.whitened) for r in rows}) == 6
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 2"), df.where("vec_id = 9"), df.where("vec_id = 4")):
        assert whitening.whiten(none).count() == 0


@pytest.mark.parametrize("big", [2.0**20, 2.0**40])
def test_exact_deviations_of_large_entries(spark, big):
    vectors = [[big + k * k, 0.5 * k, -big * (k % 3)] for k in range(9)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    x, sums, *_ = dense(vectors)
    want = {i: sum((9 * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for i, row in enumerate(x)}
    rows = whitening.whiten(df).collect()
    assert rows and all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in rows)
