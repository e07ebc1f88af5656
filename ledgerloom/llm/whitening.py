"""Whitening of embeddings by matrix-free block Lanczos.

Entries c become integers floor(SCALE * c) + OFFSET, so that counts, sums and
deviations are exact.  The covariance V of all vectors is never formed: one
pass over the table gives V X for a block X of BLOCK vectors, as the sum over
tasks of Y'(Y X) with Y the centred rows, and the block Lanczos basis on the
driver (dimensions x basis size) grows by the part of V X that is new.

* Full reorthogonalisation: each new block is made orthogonal to the whole
  basis twice.
* Breakdown: directions of a new block that vanish are replaced by random
  ones orthogonal to the basis, so an invariant subspace is left behind.
* Convergence: V times the basis is known, so residuals |V u - e u| of the
  leading Ritz pairs are exact; the iteration ends when all are below TOL times
  the largest eigenvalue, and a restart with a random block, which shows any
  eigenvalue that the first blocks missed, has changed none; or when the basis
  spans all dimensions.

The trace of V comes from the deviations, sum of (n x - S)**2 over all rows and
dimensions divided by n**3, and so explained shares need no further eigenvalue.
A last pass gathers the covariance of the whitened rows and its distance from
the identity.

Every pass reads the table's vectors again and sends what a task sums, a matrix
of dimensions x BLOCK, through one exchange that adds them up by slot of tasks;
only SLOTS sums reach the driver.  Nothing on the driver grows with the rows.

Defined results: rows whose vector is null or holds a null or an entry that is
not finite go; so do vectors of another length than the most frequent one (of
equally frequent ones, the longest), and vectors with an entry whose integer
passes 2**52.  Components whose eigenvalue is at most RANK times the trace
aren't numbered, so constant, single or empty tables give no rows.  A null
vec_id is kept; repeated rows each count and agree; within equal eigenvalues
the axes are one orthonormal choice, the same for all rows.  A deviation that
doesn't fit a long is null.  Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
BLOCK = 16
TOL = 1e-13
RANK = 1e-11
SLOTS = 32
ROWS = 4096
LIMIT = 1 << 52


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) rows with a vector of finite entries that fit, of the most frequent length."""
    c, x = F.col("embedding"), "embedding"
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < LIMIT / SCALE))
    rows = df.select("vec_id", x).where(c.isNotNull()).where(fine)
    sizes = rows.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size(x) == (sizes[0].d if sizes else 0))


def integers(column: pa.Array, base: np.ndarray | None = None) -> np.ndarray:
    """The integers of a batch of vectors, less base: rows x dimensions."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1) + OFFSET
    return x if base is None else x - base


@dataclass
class Fit:
    """n vectors; base: floor of each mean; rest: n * mean - n * base, from 0 to n - 1."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    axes: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, column: pa.Array) -> np.ndarray:
        """Rows less their mean: small integers first, so that no digit is lost."""
        return integers(column, self.base) - self.rest / self.n

    def deviations(self, column: pa.Array) -> list[int]:
        """The exact sum over dimensions of (n * x - S)**2 for each row."""
        y = integers(column, self.base)
        most = int(np.abs(y).max(initial=0)) * self.n + self.n
        if most * most * max(1, y.shape[1]) < 1 << 63:
            z = y * np.int64(self.n) - self.rest
            return (z * z).sum(axis=1).tolist()
        z = y.astype(object) * self.n - self.rest.astype(object)
        return [int(v) for v in (z * z).sum(axis=1)]


def total(rows: DataFrame, part: Callable[[pa.Array], np.ndarray], kind: str) -> np.ndarray | None:
    """The sum over all batches of part(vectors), an array of one shape; kind: long or double.  None without rows."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = part(batch.column("embedding").slice(at, ROWS))
                own = x if own is None else own + x
        if own is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task % SLOTS]), pa.array([task]), pa.array([own.ravel().astype(dtype).tobytes()])], names=["slot", "task", "sums"])

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")  # in one order, so that a lost task gives the same bits again
        own = np.zeros(len(group["sums"][0].as_py()) // 8, dtype)
        for x in group["sums"]:
            own += np.frombuffer(x.as_buffer(), dtype)
        return pa.table({"slot": group["slot"][:1], "sums": pa.array([own.tobytes()])})

    sent = rows.select("embedding").mapInArrow(run, "slot long, task long, sums binary")
    found = sent.groupBy("slot").applyInArrow(add, "slot long, sums binary").collect()
    if not found:
        return None
    # Beyond the slots integers are added without a bound.
    return np.sum([np.frombuffer(r.sums, dtype).astype(object if kind == "long" else np.float64) for r in sorted(found, key=lambda r: r.slot)], axis=0)


def mean(rows: DataFrame) -> Fit | None:
    """Count and sums; high and low halves of the integers are added apart, so that no sum overflows."""

    def part(column: pa.Array) -> np.ndarray:
        x = integers(column)
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    got = total(rows, part, "long")
    if got is None or len(got) < 3:
        return None
    d, n = (len(got) - 1) // 2, int(got[0])
    sums = [(int(hi) << 32) + int(lo) for hi, lo in zip(got[1 : d + 1], got[d + 1 :])]
    return Fit(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def orthonormal(x: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Columns of x made orthogonal to basis and each other; those that vanish, against scale, are replaced by random ones, as long as there is room."""
    room = min(x.shape[1], basis.shape[0] - basis.shape[1])
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    kept = u[:, s > 1e-10 * scale][:, :room]
    if kept.shape[1] < room:
        fill = rng.standard_normal((basis.shape[0], room - kept.shape[1]))
        kept = np.concatenate([kept, fill], axis=1)
    for _ in range(2):
        kept = kept - basis @ (basis.T @ kept)
        kept = np.linalg.qr(kept)[0]
    return kept


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, tol: float = TOL, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns): the k leading ones of the symmetric d x d matrix that apply multiplies blocks with."""
    rng, k = np.random.default_rng(seed), min(k, d)
    basis = times = np.zeros((d, 0))
    new = orthonormal(rng.standard_normal((d, min(block, d))), basis, 1.0, rng)
    settled = None  # the values before the last restart
    while True:
        product = apply(new)
        basis, times = np.concatenate([basis, new], axis=1), np.concatenate([times, product], axis=1)
        small = basis.T @ times
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1][:k], turn[:, ::-1][:, :k]
        scale = max(abs(float(value[0])), np.finfo(float).tiny)
        whole = basis.shape[1] == d
        residual = np.linalg.norm(times @ turn - basis @ turn * value, axis=0).max()
        done = len(value) == k and residual <= tol * scale * np.sqrt(d)
        same = settled is not None and done and np.abs(value - settled).max() <= 1e-9 * scale
        if whole or same:
            axes = np.linalg.qr(basis @ turn)[0]
            return value, axes
        if done:
            settled = value
        new = rng.standard_normal((d, min(block, d))) if done else product
        new = orthonormal(new, basis, scale, rng)


def fit(rows: DataFrame, components: int = 32) -> Fit | None:
    """Mean, leading axes, trace and identity error of the vectors; None without any, axes of rank 0 where all are alike."""
    got = mean(rows)
    if got is None:
        return None
    got.trace = float(total(rows, lambda c: np.array([float(sum(got.deviations(c)))]), "double")[0]) / float(got.n) ** 3
    d = len(got.base)

    def apply(x: np.ndarray) -> np.ndarray:
        def part(column: pa.Array) -> np.ndarray:
            y = got.centred(column)
            return y.T @ (y @ x)

        return total(rows, part, "double").reshape(d, -1) / got.n

    if got.trace > 0:
        value, axes = lanczos(apply, d, components)
        kept = value > RANK * got.trace
        got.values, got.axes = value[kept], axes[:, kept]
    else:
        got.values, got.axes = np.zeros(0), np.zeros((d, 0))
    k = len(got.values)

    def spread(column: pa.Array) -> np.ndarray:
        z = whitened(got, column)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    if k:
        sums = total(rows, spread, "double")
        m = sums[:k] / got.n
        got.identity_error = float(np.abs(sums[k:].reshape(k, k) / got.n - np.outer(m, m) - np.eye(k)).max())
    return got


def whitened(model: Fit, column: pa.Array) -> np.ndarray:
    return model.centred(column) @ (model.axes / np.sqrt(model.values))


def transform(rows: DataFrame, model: Fit) -> DataFrame:
    """(vec_id, deviation, whitened array) of each vector."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # dimensions x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                column = part.column("embedding")
                z = whitened(m, column)
                deviation = pa.array([v if v < 1 << 63 else None for v in m.deviations(column)], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), deviation, lists], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def whiten(df: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = vectors(df)
    model = fit(rows, components)
    if model is None:
        kind = df.schema["vec_id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(v)) for v in model.values / model.trace]) if len(model.values) else F.array().cast("array<double>")
    long = transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
