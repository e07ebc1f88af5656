"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of its byte n-grams (4 to 8, with word ends) and itself, all
hashed into 2**BITS embedding rows; a passage is the average of its words'
bags, and a linear softmax over two classes reads the average.  Embeddings and
softmax are trained jointly in numpy with Adam.  As misspellings share most of
a word's n-grams, unseen ones get nearly its vector.

A few words make a long document toxic, and an average over all of it would
drown them.  So passages are runs of PASSAGE words, a document scores as its
most toxic passage, and training sends each document's gradient to the passage
that is most toxic so far (multiple-instance learning).

The classifier is fitted on a bounded sample of labelled rows: at most
`per_class` documents of each class and `sample_bytes` bytes in all, those of
the smallest hash of doc_id; the intercept is then moved to the class shares
of all labelled rows.  Scoring is one pass over whole texts without a shuffle:
once trained, each embedding row acts only through its product with the
softmax, so 2**BITS floats are all that is sent.

Defined results: null, empty and wordless texts score as an empty passage (the
intercept alone); without labels of both classes all scores are the share of
label 1 (0 without labels); conflicting labels of one doc_id all count; rows
are scored one by one, so repeated rows agree, also those without a doc_id; an
empty table gives no rows; a very long text is scored whole, as one piece; of
equally toxic passages the first is trained; columns of docs other than doc_id
and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import ALNUM, FOLD, Text, byte_ngrams, distinct_words, pieces, segment_sum

ORDERS = (4, 5, 6, 7, 8)
BITS = 20
DIM = 8
PASSAGE = 2
PER_CLASS = 3000
SAMPLE_BYTES = 14 << 20
SPACED = 64  # passages of a text that alone is larger than its class's share of SAMPLE_BYTES
STEPS, RATE, DECAY = 40, 0.03, 1.0
LEAST_DOCS = 20


def passages(text: Text) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, word of each occurrence, bounds of passages, document of each passage)."""
    h, s, e, doc = text.words(ALNUM)
    words, which = distinct_words(text, h, s, e)
    first = np.searchsorted(doc, np.arange(len(text)))
    new = (np.arange(len(doc)) - first[doc]) % PASSAGE == 0 if len(doc) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return words, which, np.append(start, len(doc)), doc[start]


def whole_word(words: Text) -> np.ndarray:
    return (words.hashes(words.offsets[:-1], words.offsets[1:], fold=False) >> np.uint64(64 - BITS)).astype(np.int64)


def bags(words: Text) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds by word): the n-grams of each word and the word itself."""
    owner, bucket = byte_ngrams(words, ORDERS, BITS)
    owner, bucket = np.concatenate([owner, np.arange(len(words))]), np.concatenate([bucket, whole_word(words)])
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def sample_passages(texts: list[str]) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray]:
    """As passages(), for a sample of texts taken piece by piece: only hashes are held for every word."""
    known: dict[int, bytes] = {}
    hashes, docs, at = [], [], 0
    for part in pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])):
        text = Text.of(part.column("text"))
        h, s, e, doc = text.words(ALNUM)
        distinct, first = np.unique(h, return_index=True)
        raw = FOLD[text.data].tobytes()
        for x, a, b in zip(distinct.tolist(), s[first].tolist(), e[first].tolist()):
            if x not in known:
                known[x] = b"<" + raw[a:b] + b">"
        hashes.append(h)
        docs.append((doc + at).astype(np.int32))
        at += len(text)
    keys = np.array(sorted(known), np.uint64)
    words = Text.of(pa.array([known[k] for k in keys.tolist()], pa.large_binary()))
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    which = np.searchsorted(keys, h).astype(np.int32)
    first = np.searchsorted(doc, np.arange(len(texts)))
    start = np.flatnonzero((np.arange(len(doc)) - first[doc]) % PASSAGE == 0)
    return words, which, np.append(start, len(doc)), doc[start].astype(np.int64)


class Model:
    def __init__(self, rows: np.ndarray, intercept: float):
        """rows: the product of each embedding row and the softmax's class difference."""
        self.rows, self.intercept = rows, intercept

    def score(self, text: Text) -> np.ndarray:
        top = np.full(len(text), -np.inf)
        words, which, bounds, doc = passages(text)
        if len(doc):
            bucket, own = bags(words)
            value = segment_sum(self.rows[bucket], own) / np.maximum(np.diff(own), 1)
            np.maximum.at(top, doc, segment_sum(value[which], bounds) / np.diff(bounds))
        z = np.where(np.isfinite(top), top, 0.0) + self.intercept
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax; share: of label 1 among all labelled rows.

    Only rows that occur in at least LEAST_DOCS documents are trained, the
    others stay at 0: a row of few documents would be learned by heart.  The
    first embedding axis starts from each row's shrunk log odds between the
    classes, so that the first choice of most toxic passages is a sensible one.
    """
    words, which, bounds, doc = sample_passages(texts)
    size = np.diff(words.offsets)
    per_word = 1 + sum(np.maximum(size - n + 1, 0) for n in ORDERS)
    per_passage = np.diff(bounds)
    pair = np.unique(np.repeat(doc, per_passage) * len(words) + which)
    in_docs = [np.bincount(pair[labels[pair // len(words)] == y] % len(words), minlength=len(words)) for y in (0, 1)]
    del pair
    # Order by order, so that only entries of trained rows are held.  n-grams of two words of a document count twice.
    seen, parts = [np.zeros(1 << BITS), np.zeros(1 << BITS)], []
    for n in (*ORDERS, 0):
        owner, bucket = byte_ngrams(words, (n,), BITS) if n else (np.arange(len(words)), whole_word(words))
        own_seen = [np.bincount(bucket, weights=c[owner], minlength=1 << BITS) for c in in_docs]
        keep = (own_seen[0] + own_seen[1])[bucket] >= LEAST_DOCS
        parts.append((owner[keep].astype(np.int32), bucket[keep].astype(np.int32)))
        seen = [a + b for a, b in zip(seen, own_seen)]
    owner, bucket = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    used, slot = np.unique(bucket, return_inverse=True)
    own = np.searchsorted(owner, np.arange(len(words) + 1))
    del parts, order, bucket

    n1, n0 = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    p, q = seen[1][used], seen[0][used]
    # How far the odds are from chance in standard deviations decides how much of them is believed.
    odds = np.log((p + 0.5) / n1) - np.log((q + 0.5) / n0)
    sure = np.maximum(np.abs(p - (p + q) * n1 / (n1 + n0)) / np.sqrt((p + q) * n1 * n0 / (n1 + n0) ** 2 + 1) - 2.0, 0.0)
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-0.5, 0.5, (len(used), DIM)) / DIM * 0.1
    embedding[:, 0] += 8.0 * odds * sure / (sure + 4.0)
    softmax = rng.normal(0, 0.1, (DIM, 2))
    softmax[0] = -0.5, 0.5
    bias = np.array([2.0, -2.0])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (embedding, softmax, bias)]
    some = np.bincount(doc, minlength=len(texts)) > 0
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0) * some
    for step in range(1, STEPS + 1):
        axis = softmax[:, 1] - softmax[:, 0]
        value = segment_sum((embedding @ axis)[slot], own) / per_word
        z = segment_sum(value[which], bounds) / per_passage
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, z)
        pick = np.full(len(texts), -1)
        hit = np.flatnonzero(z == top[doc])
        pick[doc[hit[::-1]]] = hit[::-1]  # the first of equals
        live = pick >= 0
        prob = 1 / (1 + np.exp(-np.clip(np.where(live, top, 0) + bias[1] - bias[0], -40, 40)))
        error = np.where(live, (prob - labels) * weight, 0.0)
        # Passage -> word -> row.
        at = np.zeros(len(z))
        at[pick[live]] = error[live] / per_passage[pick[live]]
        to_word = np.bincount(which, weights=np.repeat(at, per_passage), minlength=len(words)) / per_word
        to_row = np.bincount(slot, weights=to_word[owner], minlength=len(used))
        pull = embedding.T @ to_row
        grads = [np.outer(to_row, axis) + DECAY / max(1, len(used)) * embedding, np.stack([-pull, pull], axis=1), np.array([-error.sum(), error.sum()])]
        for param, grad, (m, v) in zip((embedding, softmax, bias), grads, state):
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-9)
    rows = np.zeros(1 << BITS)
    rows[used] = embedding @ (softmax[:, 1] - softmax[:, 0])
    return Model(rows.astype(np.float32), float(bias[1] - bias[0] + np.log(share / (1 - share))))


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitting(sizes: list[int], room: int) -> list[bool]:
    """Which texts are taken, in order: each that fits in what is left.  Where none does, the first, of which `spaced` passages are taken."""
    out = []
    for size in sizes:
        out.append(size <= room)
        room -= size * out[-1]
    return out if any(out) or not out else [True, *out[1:]]


def spaced(text: Column, room: int) -> Column:
    """Evenly spaced passages of a text, of at most `room` bytes together."""
    each, count = max(1, room // (5 * SPACED)), F.length(text)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SPACED - 1)), lambda i: F.substr(text, (F.floor(i * count / SPACED) + 1).cast("int"), F.lit(each))), " ")


def candidates(docs: DataFrame, marked: DataFrame, shares: dict[int, float]) -> DataFrame:
    """(doc_id, y, h, t, size): of each class the share of labelled documents of the smallest hashes h of doc_id, one row for an id and label.

    Of an id with several texts, the one of the smallest hash t counts, so the
    rows are bounded by the share, however often an id occurs.
    """
    h = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 40))
    cut = F.when(F.col("y") == 1, int(shares[1] * (1 << 40))).otherwise(int(shares[0] * (1 << 40)))
    few = marked.withColumn("h", h).where(F.col("h") < cut).distinct()
    texts = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), F.octet_length("text").alias("size"))
    return few.join(texts, "doc_id").groupBy("doc_id", "y", "h").agg(F.min(F.struct("t", "size")).alias("m")).select("doc_id", "y", "h", "m.t", "m.size")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """From rows of labels (doc_id, toxic) that aren't held out, and the texts of docs."""
    marked = labels.where(~held_out()).where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id"), (F.col("toxic") == 1).cast("int").alias("y"))
    n = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        share = min(max(n.get(1, 0) / max(1, sum(n.values())), 1e-9), 1 - 1e-9)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    chosen = candidates(docs, marked, {y: min(1.0, per_class / n[y]) for y in (0, 1)}).toPandas()
    chosen = chosen.sort_values(["h", "doc_id", "y", "size"], kind="stable")
    kept = []
    for y in (0, 1):
        own = chosen[chosen.y == y]
        kept.append(own[fitting(own["size"].tolist(), sample_bytes // 2)].head(per_class))
    ids = sorted({(int(i), int(t)) for k in kept for i, t in zip(k.doc_id, k.t)})
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, t long"))  # at most 2 * per_class ids
    long = F.octet_length("text") > sample_bytes // 2
    held = F.when(long, spaced(F.col("text"), sample_bytes // 2)).otherwise(F.col("text")).alias("text")
    own = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), held).join(wanted, ["doc_id", "t"])
    texts = {r.doc_id: r.text for r in own.groupBy("doc_id").agg(F.first("text").alias("text")).collect()}
    rows = [(texts[i], y) for y in (0, 1) for i in kept[y].doc_id.astype(int) if i in texts]
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(n[1] / n[0])))
    return train([t for t, _ in rows], np.array([y for _, y in rows], float), n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(Text.of(part.column("text"))))], names=["doc_id", "toxicity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, toxicity double")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    found = score(docs, fit(docs, labels, per_class))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
