"""Periodic runs of words by a scan over all lags.

A run of period q is a maximal stretch of words in which words q apart are
identical, q is the smallest period, and the length is at least `least` words
and `exponent` periods.  A text of n words is compared with itself shifted by
every lag up to n / exponent: equal neighbours are true stretches, and their
lengths are read off the edges of the comparison (run-length coding).

Most lags have no run.  A run of period q is a stretch of at least
max(least - q, (exponent - 1) * q) equal positions; one position in as many,
less GRAM - 1, is probed on hashes of GRAM words first, which no run can slip
through; a lag that fires is compared on word ids in full.  Probes of many
texts and lags are one array pass.

Spark splits the work by document and lag: texts of under LARGE bytes are
scanned where they are read; a larger one becomes word ids and is dealt as
ranges of lags of at most WORK comparisons each over the cluster, whose runs
meet again by document.  A lag's stretches need no other lag: the smallest
period of a stretch divides its lag (Fine and Wilf, as exponent >= 2), so each
prime divisor is tested within the stretch itself.

Defined results: a null, empty or wordless text has no run; repeated rows agree;
an empty table gives no rows; ties for the best run go to the smallest start,
then period; a text is held whole by one task, a very long one takes about 50
bytes a byte there; columns other than doc_id and text are ignored.  Words are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import NOT_SPACE, U64, Text, mix, pieces, ragged

GRAM = 8
LARGE = 1 << 20
WORK = 1 << 34
PROBES = 1 << 19
_BASE = U64(0x9E3779B97F4A7C15)


def stretch(lag: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """The fewest equal positions in a row that a run of this period has."""
    return np.maximum(least - lag, (exponent - 1) * lag)


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM words from each position on, by doubling; the last GRAM - 1 positions have none."""
    width = 1
    while width < GRAM:
        h = mix(h[:-width] * _BASE + h[width:]) if len(h) > width else h[:0]
        width *= 2
    return h


def firing(gram: np.ndarray, first: np.ndarray, n: np.ndarray, lags: tuple[np.ndarray, np.ndarray], least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, lag) pairs of `lags` that a run may have; first, n: first word and number of words of each text."""
    doc, lag = lags
    step = np.maximum(stretch(lag, least, exponent) - GRAM + 1, 1)
    count = np.maximum(n[doc] - lag - GRAM, -1) // step + 1
    upto = np.concatenate([[0], np.cumsum(count)])
    out, at = [], 0
    while at < len(lag):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PROBES, side="right")) - 1)
        owner, k = ragged(count[at:to])
        place = first[doc[at:to]][owner] + k * step[at:to][owner]
        hit = gram[place] == gram[place + lag[at:to][owner]]
        out.append(at + np.unique(owner[hit]))
        at = to
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return doc[found], lag[found]


def divisors(q: int) -> list[int]:
    """q over each of its prime divisors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, q // rest] if rest > 1 else out


def runs_of_lag(ids: np.ndarray, q: int, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of smallest period q, by comparing all words with those q on."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-q] == ids[q:], [False]])))
    start, size = edge[::2], edge[1::2] - edge[::2]
    fits = size >= max(least - q, (exponent - 1) * q)
    out = []
    for s, k in zip(start[fits].tolist(), size[fits].tolist()):
        if not any(np.array_equal(ids[s : s + q], ids[s + d : s + d + q]) for d in divisors(q)):
            out.append((s, k + q, q))
    return out


def word_ids(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, id of each word, first word of each text, number of words of each text)."""
    s, e, doc = text.word_bounds(NOT_SPACE)
    h = text.hashes(s, e, fold=False)
    n = np.bincount(doc, minlength=len(text)) if len(text) else np.zeros(0, np.int64)
    return h, np.unique(h, return_inverse=True)[1].astype(np.int32), np.cumsum(n) - n, n


def scan(text: Text, least: int, exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each text that has any."""
    h, ids, first, n = word_ids(text)
    doc, k = ragged(np.where(n >= least, n // exponent, 0))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for d, q in zip(*(x.tolist() for x in firing(grams(h), first, n, (doc, k + 1), least, exponent))):
        runs = runs_of_lag(ids[first[d] : first[d] + n[d]], q, least, exponent)
        if runs:
            found.setdefault(d, []).extend(runs)
    return found


def lag_ranges(n: int, exponent: int) -> list[tuple[int, int]]:
    """Ranges of lags, from one to before the other, of at most WORK comparisons each; for a text of n words."""
    last = n // exponent
    each = max(1, WORK // max(n, 1))
    return [(lo, min(lo + each, last + 1)) for lo in range(1, last + 1, each)]


def digest(raw: bytes, runs: list[tuple[int, int, int]]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text and its runs."""
    runs = sorted((s, q, k) for s, k, q in runs)
    words = raw.split()  # bytes split at exactly the six white spaces of ASCII
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, q, k in runs:
            drop[s + q] += 1
            drop[s + k] -= 1
        words = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
        s, q, k = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]))
        best = (s, k, q, 1000 * k // q)
    else:
        best = (None,) * 4
    listed = "".join(f"{s},{k},{q}\n" for s, q, k in runs)
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", RUN)]
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"


def _rows(ids: pa.Array, text: Text, found: dict[int, list[tuple[int, int, int]]]) -> pa.RecordBatch:
    made = [digest(text.data[text.offsets[d] : text.offsets[d + 1]].tobytes(), found.get(d, [])) for d in range(len(text))]
    listed = [[{"start": s, "length": k, "period": q} for s, k, q in sorted(found.get(d, []), key=lambda r: (r[0], r[2]))] for d in range(len(text))]
    columns = [*(list(c) for c in zip(*made)), listed]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS))], names=["doc_id", *(name for name, _ in FIELDS)])


def find(docs: DataFrame, least: int = 24, exponent: int = 3) -> DataFrame:
    """(doc_id, n_runs, the best run, digests, runs) for every row of docs."""
    if exponent < 2 or stretch(np.arange(1, least + 1), least, exponent).min() < GRAM:
        raise ValueError(f"runs must have {GRAM} equal positions in a row and two periods")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    large = F.coalesce(F.octet_length("text"), F.lit(0)) >= LARGE

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                text = Text.of(part.column("text"))
                yield _rows(part.column("doc_id"), text, scan(text, least, exponent))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1):
                _, ids, _, n = word_ids(Text.of(part.column("text")))
                for lo, hi in lag_ranges(int(n.sum()), exponent):
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([lo]), pa.array([hi]), pa.array([ids.tobytes()], pa.binary())], names=["key", "lo", "hi", "ids"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lo, hi, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, np.int32)
                lags = np.arange(lo, hi)
                gram = grams(mix(ids.astype(U64)))
                _, fired = firing(gram, np.zeros(1, np.int64), np.array([len(ids)]), (np.zeros(len(lags), np.int64), lags), least, exponent)
                found = [r for q in fired.tolist() for r in runs_of_lag(ids, q, least, exponent)]
                s, k, q = (pa.array([r[i] for r in found], pa.int64()) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), s, k, q], names=["key", "start", "length", "period"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1):
                found = [(r["start"], r["length"], r["period"]) for r in part.column("runs").to_pylist()[0] or []]
                yield _rows(part.column("doc_id"), Text.of(part.column("text")), {0: found})

    small = rows.where(~large).mapInArrow(whole, f"doc_id {kind}, {SCHEMA}")
    keyed = rows.where(large).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("text")), 256))
    dealt = keyed.select("key", "text").mapInArrow(deal, "key string, lo long, hi long, ids binary").repartition(F.col("key"), F.col("lo"))
    runs = dealt.mapInArrow(ranges, "key string, start long, length long, period long").groupBy("key").agg(F.collect_set(F.struct("start", "length", "period")).alias("runs"))
    return small.unionByName(keyed.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(join, f"doc_id {kind}, {SCHEMA}"))


def tiled(key: Column, text: Column) -> Column:
    """The text, and for one doc_id in ten its words with a tail that repeats: words from a on are every time the p words from a on.

    With h the CRC-32 of the id and g = h div 10: a = g mod n, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(text)), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, made).otherwise(text)
