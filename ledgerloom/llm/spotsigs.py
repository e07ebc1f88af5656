"""Document fingerprints by SpotSigs.

Anchors are common words; a signature is an anchor with the CHAIN content
words that follow it, other anchors skipped.  A text's fingerprint is the
sorted set of its signatures' 32-bit hashes, in hex.  Texts of fewer than
LEAST chains, which anchors don't describe, take pairs of consecutive words
(or their one word, or a hash of the wordless text) instead.

Fingerprints are compared by their full Jaccard likeness.  A set's partition by
length (a likeness of `least` or more can only lie within a partition or between
neighbours) is a column of the result; nothing is searched or pruned by it here,
as each text meets only its edit and its successor, whose likeness is asked for
however low it is.

`neighbours` compares every document with its edited text and with the next
one.  Documents are dealt into ranges of descending doc_id by cut points from
the ids alone; each range also gets the first document of the next range, so
one exchange of the texts is enough, and a task streams its range with one
row of look-ahead.  Ids travel to the driver only as cut points, at most one
for each partition.

Defined results: a null text counts as empty; an empty text has the empty
fingerprint, two empty fingerprints are alike by 1.0, an empty and a non-empty
one by 0.0; a null doc_id sorts below all others; documents that share a
doc_id follow each other in order of text, and of equal ones either is next; a
lone document is its own next; an empty table gives no rows; a very long text is
hashed piece by piece of the batch, as one text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import partitions
from .kernel import ALNUM, U64, Text, mix, pieces

#: Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be by for from he in is it of on or that the this to was were will with
au aux avec ce dans de des du elle en est et il la le les ne pas pour que qui se sur un une
auf das dem den der des die ein eine er es für ich im in ist mit nicht sie sich und von zu
al como con del el ella en es ese esta la las lo los más no para por que se su un una y
""".split()
CHAIN = 2
LEAST = 4
_MUL = U64(0xC2B2AE3D27D4EB4F)


def _anchor_hashes() -> np.ndarray:
    h, _, _, _ = Text.of_strings(sorted(set(ANCHORS))).words(ALNUM)
    return np.sort(h)


def signature_sets(text: Text, anchors: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text."""
    n = len(text)
    h, _, _, doc = text.words(ALNUM)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    where = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
    common = anchors[where] == h if len(h) else np.zeros(0, bool)
    spots, content = np.flatnonzero(common), np.flatnonzero(~common)
    k = np.searchsorted(content, spots)
    ok = k + CHAIN <= len(content)
    spots, k = spots[ok], k[ok]
    sig = h[spots]
    inside = np.ones(len(spots), bool)
    for j in range(CHAIN):
        at = content[k + j]
        sig = mix(sig * _MUL + h[at])
        inside &= doc[at] == doc[spots]
    sig, owner = sig[inside], doc[spots[inside]]
    few = np.bincount(owner, minlength=n) < LEAST
    rest = few[doc]
    pair = np.flatnonzero(rest[:-1] & (doc[1:] == doc[:-1])) if len(h) > 1 else np.zeros(0, np.int64)
    lone = bounds[:-1][few & (np.diff(bounds) == 1)]
    sig = np.concatenate([sig[~few[owner]], mix(h[pair] * _MUL + h[pair + 1] + U64(1)), mix(h[lone] + U64(2))])
    owner = np.concatenate([owner[~few[owner]], doc[pair], doc[lone]])
    key = np.unique(owner.astype(U64) << U64(32) | sig >> U64(32))
    sets = np.split((key & U64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(key >> U64(32), np.arange(1, n).astype(U64))) if n else []
    for d in np.flatnonzero((np.diff(bounds) == 0) & (np.diff(text.offsets) > 0)):
        raw = text.data[text.offsets[d] : text.offsets[d + 1]].tobytes()
        sets[d] = np.frombuffer(hashlib.sha256(raw).digest()[:4], ">u4").astype(np.uint32)
    return sets


def render(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def length_partition(n: int, least: float) -> int:
    """Sets alike by `least` or more lie in one partition or in neighbouring ones."""
    return int(math.log(max(n, 1)) / -math.log(least))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness, or 0.0 where the lengths show that it can't reach `least`."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edit(text: str, following: str) -> str:
    """The second half replaced by the beginning of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _range(value: Column, cuts: list[int]) -> Column:
    """How many of the descending cuts are above a value, in two steps of about sqrt(cuts) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    last = F.array(*[F.lit(c[-1]) for c in chunks])
    coarse = F.size(F.filter(last, lambda x: x > value))
    fine = F.element_at(F.array(*[F.array(*[F.lit(v) for v in c]) for c in chunks]), F.least(coarse + 1, F.lit(len(chunks))))
    return F.when(coarse >= len(chunks), len(cuts)).otherwise(coarse * step + F.size(F.filter(fine, lambda x: x > value)))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, length_partition int"


def neighbours(docs: DataFrame, least: float = 0.8, ranges: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text), as SCHEMA says; `least` only sets the width of length partitions."""
    spark = docs.sparkSession
    ranges = ranges or 2 * partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = rows.select(order.alias("o"))
    cuts = ids.agg(F.percentile_approx("o", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("c")).first().c if ranges > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    rows = rows.withColumn("o", order).withColumn("part", _range(order, cuts))
    firsts = sorted((r.part, r.o) for r in ids.select("o", _range(F.col("o"), cuts).alias("part")).groupBy("part").agg(F.max("o").alias("o")).collect())
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    # The first document of each range closes the range before it; the very first closes the last.
    closes = [(o, firsts[i - 1][0]) for i, (_, o) in enumerate(firsts)]
    heads = rows.join(F.broadcast(spark.createDataFrame(closes, "o long, close int")), "o").groupBy("o", "close").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "o", F.col("close").alias("part"), F.lit(True).alias("head"))
    dealt = rows.withColumn("head", F.lit(False)).unionByName(heads).repartition(ranges, "part").sortWithinPartitions("part", "head", F.col("o").desc(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchor_hashes()
        held: tuple | None = None
        for batch in batches:
            for part in pieces(batch):
                sets = signature_sets(Text.of(part.column("text")), anchors)
                own = list(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("head").to_pylist(), sets))
                if held is not None:
                    own.insert(0, held)
                held = own[-1]
                pairs = [(x, y) for x, y in zip(own, own[1:]) if not x[2]]
                edited = [edit(x[1], y[1]) for x, y in pairs]
                column = pa.array(edited, pa.large_string())
                again: list[np.ndarray] = []
                for p in pieces(pa.RecordBatch.from_arrays([column], names=["text"])):
                    again += signature_sets(Text.of(p.column("text")), anchors)
                out = [
                    (x[0], len(x[1]), hashlib.sha256(t.encode()).hexdigest(), render(x[3]), render(s), likeness(x[3], s), likeness(x[3], y[3]), len(x[3]), length_partition(len(x[3]), least))
                    for (x, y), t, s in zip(pairs, edited, again)
                ]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)], names=names)

    return dealt.select("doc_id", "text", "head").mapInArrow(run, SCHEMA)
