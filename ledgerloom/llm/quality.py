"""Quality scores from hashed word n-grams and a logistic regression trained by FTRL.

Words are runs of letters and digits, and runs of other signs.  Features are
their n-grams, hashed into 2**BITS weights: single words and pairs with A-Z
lower-cased, and one to three shapes in a row, where a word's shape is its case
and digits and a run of signs stands for itself, so that invented words have
features too.  A feature's value is the square root of its count, and a text's
values have length one.

The weights follow the regularised leader (FTRL-proximal): each coordinate has
its own rate by the squares of its gradients, and l1 keeps rare ones at zero.
Documents are taken one by one, in order of a hash, for EPOCHS rounds.  The
intercept is then moved from the sample's class shares to those of all labels.

The classifier is fitted on a bounded sample of labelled rows: of each class
the documents of the smallest hash of doc_id, at most `per_class` of them and
until their texts have `sample_bytes` bytes; the one that passes that bound is
still taken, so long texts aren't left out.  Executors make their features;
the driver holds those of the sample alone, at most 2**BITS for a text.
Scoring is one pass over whole texts without a shuffle: sparse dot products
with the weights, which are all that is sent.

Defined results: null, empty and blank texts score as the intercept; without
labels of both classes all scores are the share of label 1 (0.5 without
labels); each distinct (doc_id, label) counts once, so conflicting labels both
count; of several texts of a doc_id the one of the smallest hash is learned;
rows are scored one by one, so repeated rows agree; an empty table gives no
rows; a very long text is scored whole, as one piece; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALNUM, SPACE, U64, Text, mix, pieces

BITS = 18
PER_CLASS = 2500
SAMPLE_BYTES = 6 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.01, 6
SIGNS = ~(ALNUM | SPACE)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BASE = U64(0x9E3779B97F4A7C15)


def _any(table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(table[data])])
    return upto[end] > upto[start]


def features(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds by text, buckets, values): the sparse rows of the texts, buckets rising within each."""
    words, signs = text.word_bounds(ALNUM), text.word_bounds(SIGNS)
    start, end, doc = (np.concatenate(c) for c in zip(words, signs))
    sign = np.repeat([False, True], [len(words[0]), len(signs[0])])
    order = np.argsort(start, kind="stable")
    start, end, doc, sign = start[order], end[order], doc[order], sign[order]
    word = text.hashes(start, end)
    case = sum(_any(t, text.data, start, end).astype(np.int64) << i for i, t in enumerate((_UPPER, _LOWER, _DIGIT)))
    first = _UPPER[text.data[start]] if len(start) else np.zeros(0, bool)
    shape = np.where(sign, word, mix((case + 8 * first + 16).astype(U64)))
    owners, hashes = [], []
    for kind, h, orders in ((1, word, (1, 2)), (2, shape, (1, 2, 3))):
        for n in orders:
            at = np.arange(max(0, len(h) - n + 1))
            at = at[doc[at] == doc[at + n - 1]]
            own = h[at]
            for j in range(1, n):
                own = mix(own * _BASE + h[at + j])
            owners.append(doc[at])
            hashes.append(mix(own + U64(kind * 8 + n)) >> U64(64 - BITS))
    key, count = np.unique((np.concatenate(owners) << BITS) | np.concatenate(hashes).astype(np.int64), return_counts=True)
    bounds = np.searchsorted(key, np.arange(len(text) + 1) << BITS)
    value = np.sqrt(count)
    length = np.sqrt(np.add.reduceat(np.append(count, 0), bounds[:-1]).astype(np.float64)) if len(text) else np.zeros(0)
    return bounds, key & ((1 << BITS) - 1), value / np.repeat(np.maximum(length, 1.0), np.diff(bounds))


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: Text) -> np.ndarray:
        bounds, bucket, value = features(text)
        upto = np.concatenate([[0.0], np.cumsum(self.weights[bucket] * value)])
        z = np.where(np.diff(bounds) > 0, upto[bounds[1:]] - upto[bounds[:-1]], 0.0) + self.intercept
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over (buckets, values) rows in their order; share: of label 1 among all labels."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(epochs):
        for (at, x), y in zip(rows, labels.tolist()):
            zi, ni = z[at], n[at]
            w = -np.sign(zi) * np.maximum(np.abs(zi) - L1, 0.0) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
            b = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            error = 1.0 / (1.0 + np.exp(-min(max(float(w @ x) + b, -40.0), 40.0))) - y
            g = error * x
            after = ni + g * g
            z[at] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / ALPHA * w
            n[at] = after
            afterb = nb + error * error
            zb += error - (np.sqrt(afterb) - np.sqrt(nb)) / ALPHA * b
            nb = afterb
    weights = -np.sign(z) * np.maximum(np.abs(z) - L1, 0.0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    held = min(max(float(labels.mean()), 1e-9), 1 - 1e-9)
    return Model(weights, float(-zb / ((BETA + np.sqrt(nb)) / ALPHA)) + _logit(share) - _logit(held))


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """From rows of labels (doc_id, quality) that aren't held out, and the texts of docs."""
    marked = labels.where(~held_out()).where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 1).cast("int").alias("y")).distinct()
    n = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values())) if n else 0.5
    if not n.get(0) or not n.get(1):
        return Model(np.zeros(1 << BITS), _logit(share))
    spark = docs.sparkSession
    h = F.xxhash64("doc_id", F.lit(12))
    ids = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy(h, "doc_id").limit(per_class).collect()]
    wanted = F.broadcast(spark.createDataFrame(ids, marked.schema))  # at most 2 * per_class rows
    texts = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text")).join(wanted, "doc_id").withColumn("t", F.xxhash64("text"))
    sizes = texts.groupBy("doc_id", "y").agg(F.min(F.struct("t", F.octet_length("text").alias("size"))).alias("m")).select("doc_id", "y", "m.*", h.alias("h")).collect()
    taken = {}
    for y in (0, 1):
        room = sample_bytes
        for r in sorted((r for r in sizes if r.y == y), key=lambda r: (r.h, r.doc_id)):
            if room > 0:
                taken[r.doc_id, y, r.t] = r.h
                room -= r.size
    if len({y for _, y, _ in taken}) < 2:
        return Model(np.zeros(1 << BITS), _logit(share))
    kind = marked.schema["doc_id"].dataType.simpleString()

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                bounds, bucket, value = features(Text.of(part.column("text")))
                packed = [[x[a:b].astype(t).tobytes() for a, b in zip(bounds[:-1], bounds[1:])] for x, t in ((bucket, np.int32), (value, np.float32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), part.column("t"), *(pa.array(c, pa.binary()) for c in packed)], names=["doc_id", "y", "t", "bucket", "value"])

    chosen = F.broadcast(spark.createDataFrame([(*k,) for k in taken], f"doc_id {kind}, y int, t long"))  # at most 2 * per_class rows
    made = texts.join(chosen, ["doc_id", "y", "t"]).select("doc_id", "y", "t", "text").mapInArrow(sparse, f"doc_id {kind}, y int, t long, bucket binary, value binary")
    found = {(r.doc_id, r.y, r.t): r for r in made.groupBy("doc_id", "y", "t").agg(F.first("bucket").alias("bucket"), F.first("value").alias("value")).collect()}
    keys = sorted(found, key=lambda k: (taken[k], k))
    rows = [(np.frombuffer(found[k].bucket, np.int32), np.frombuffer(found[k].value, np.float32).astype(np.float64)) for k in keys]
    return train(rows, np.array([y for _, y, _ in keys], float), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(Text.of(part.column("text"))))], names=["doc_id", "quality"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, quality double")


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    found = score(docs, fit(docs, labels, per_class, sample_bytes))
    return found.select("doc_id", held_out().alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))
