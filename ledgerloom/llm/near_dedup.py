"""Near-duplicate documents by MinHash, exactly confirmed.

One pass over the texts makes, for each document, the set of its distinct word
shingles, 128 universal-hash minima of it, 32 band keys of four minima, a
byte-wise signature of the minima and a 128-bit digest of the set.  Then:

1. Documents of equal sets fall into classes (partial aggregation); only the
   smallest id of a class goes on, so copies never meet each other.
2. In each band bucket every document is paired with the bucket's smallest
   id.  Pairs whose signatures agree well enough are confirmed on full sets;
   confirmed pairs give components by large-star and small-star.
3. Buckets that still hold several components are searched once more, over
   pairs from different components only.  The task that holds a tile of a
   bucket compares its pairs by signature and then by bitmaps of the sets
   (shingle hashes cut to 16 bits), and emits only the pairs that pass; these
   are confirmed on full sets.  So all links between different components are
   found, while pairs that aren't links never become rows.

Two documents at the threshold of 0.8 share no bucket with probability
(1 - 0.8**4)**32 = 5e-8; the signature test (agreement of at least 76 of 128, six
standard deviations below) drops such a pair with probability 2e-8.  The bitmap
test drops no link.  Confirmation counts the shingles' 64-bit hashes of both
texts.

Every join of two sides that grow with the input is a merge join: nothing of
unknown size is broadcast, and the plan has one shape at every size.

Memory in a task: a bucket is compared in tiles of at most TILE signatures,
and a pair's texts stream past the set of the pair's first member, with a salt
for first members of many pairs.

Defined results: a null, empty or wordless text has no shingles, is linked
with nothing and is its own component; fewer words than a shingle make one
shingle; rows that repeat a doc_id are one document and get a row each; a null
doc_id is never linked and has a null component; an empty table gives no rows;
of equal sets the smallest doc_id stands for all; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import forget, written
from .components import components
from .kernel import NOT_SPACE, U64, Text, mix, pieces, seeded

HASHES, ROWS = 128, 4
LEAST_AGREEMENT = 0.59375  # 76 of 128
TILE = 2048
PER_SALT = 64
_MUL = U64(0xC2B2AE3D27D4EB4F)


def shingle_sets(text: Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all documents in order, sorted in each; offsets by document)."""
    words, _, _, doc = text.words(NOT_SPACE)
    n = len(text)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(bounds)
    if not len(words):
        return words, np.zeros(n + 1, np.int64)
    h = words.copy()
    for k in range(1, size):
        h = h * _MUL
        h[:-k] += words[k:]
    place = np.arange(len(words)) - bounds[doc]
    whole = mix(h)
    keep = place <= count[doc] - size
    for d in np.flatnonzero((count > 0) & (count < size)):  # the whole sequence as one
        a, b = bounds[d], bounds[d + 1]
        x = U64(b - a)
        for w in words[a:b]:
            x = mix(np.array([x * _MUL + w]))[0]
        whole[a], keep[a] = x ^ U64(0xA5A5A5A5A5A5A5A5), True
    x, doc = whole[keep], doc[keep]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        x[a:b].sort()
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return x[fresh], np.searchsorted(doc[fresh], np.arange(n + 1))


def sketch(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band keys, signature bytes, set digests) of the non-empty sets."""
    a, b = seeded(HASHES, 11) | U64(1), seeded(HASHES, 12)
    starts = bounds[:-1][np.diff(bounds) > 0]
    minima = np.empty((len(starts), HASHES), U64)
    for k in range(HASHES):
        minima[:, k] = np.minimum.reduceat(x * a[k] + b[k], starts)
    keys = np.zeros((len(starts), HASHES // ROWS), U64)
    for r in range(ROWS):
        keys = mix(keys * _MUL + minima[:, r::ROWS])
    keys = mix(keys + np.arange(HASHES // ROWS, dtype=U64) * U64(0x9E3779B97F4A7C15))
    digest = np.stack([np.add.reduceat(mix(x + U64(s)), starts) for s in (1, 2)], axis=1)
    return keys, (mix(minima) & U64(255)).astype(np.uint8), digest


SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sig binary, low binary"


def sketches(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in pieces(batch):
                    x, bounds = shingle_sets(Text.of(part.column("text")), size)
                    n, full = np.diff(bounds), np.diff(bounds) > 0
                    m, at = len(n), np.flatnonzero(full)
                    d = np.zeros((m, 2), np.int64)
                    per = HASHES // ROWS
                    offsets = np.zeros(m + 1, np.int32)
                    np.cumsum(full * per, out=offsets[1:])
                    sig: list[bytes | None] = [None] * m
                    low: list[bytes | None] = [None] * m
                    keys = np.zeros(0, np.int64)
                    if len(at):
                        k, s, digest = sketch(x, bounds)
                        keys, d[at] = k.view(np.int64).ravel(), digest.view(np.int64)
                        for i, row in zip(at.tolist(), s):
                            sig[i] = row.tobytes()
                            low[i] = np.unique((x[bounds[i] : bounds[i + 1]] & U64(0xFFFF)).astype(np.uint16)).tobytes()
                    none = pa.array(~full)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(d[:, j], mask=~full) for j in (0, 1)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)), pa.array(sig, pa.binary()), pa.array(low, pa.binary())],
                        names=["doc_id", "n_shingles", "d1", "d2", "keys", "sig", "low"],
                    )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _agree(pairs: DataFrame) -> DataFrame:
    """(a, b, sig_a, sig_b) rows whose signatures agree well enough, as (a, b)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = [np.frombuffer(Text.of(batch.column(c)).data, np.uint8).reshape(batch.num_rows, HASHES) for c in ("sig_a", "sig_b")]
                keep = (s[0] == s[1]).sum(axis=1) >= LEAST_AGREEMENT * HASHES
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def may_link(both: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, merged_a: np.ndarray, merged_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes, whose bitmaps have `both` bits in common, can be a linked pair.

    merged: how many shingles of a set share the bit of another one of it.
    Each common shingle sets a bit in both maps, so there are at most
    both + min(merged) common shingles: no link fails this.
    """
    common = both + np.minimum(merged_a, merged_b)
    return den * common >= num * (size_a + size_b - common)


def _tiles(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs from different components within a bucket, for (key, tile, side, doc_id, label, n_shingles, sig, low) rows sorted by tile.

    side 0 rows of a tile meet each other (or, in a tile of two blocks, its
    side 1 rows).  A pair passes if its bitmaps may be a linked pair's.
    """

    def emit(ids, labels, sigs, side, full, low):
        out = []
        maps = np.zeros((len(ids), 1 << 10), U64)
        for i, own in enumerate(low):
            bits = np.zeros(1 << 16, np.uint8)
            bits[np.frombuffer(own, np.uint16)] = 1
            maps[i] = np.packbits(bits).view(U64)
        merged = full - np.array([len(own) // 2 for own in low])
        for i in range(0, len(ids), 64):
            own = slice(i, min(i + 64, len(ids)))
            if (side[own] == 1).all():
                continue
            near = (sigs[own, None, :] == sigs[None, :, :]).sum(axis=2) >= LEAST_AGREEMENT * HASHES
            near &= (labels[own, None] != labels[None, :]) & (side[own, None] == 0)
            near &= (side[None, :] == 1) if side.any() else (ids[own, None] < ids[None, :])
            p, q = np.nonzero(near)
            good = np.zeros(len(p), bool)
            for j in range(0, len(p), 512):
                a, b = p[j : j + 512] + i, q[j : j + 512]
                both = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64)
                good[j : j + 512] = may_link(both, full[a], full[b], merged[a], merged[b], num, den)
            out.append(np.stack([ids[own][p[good]], ids[q[good]]], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            if not table.num_rows:
                return
            key = table.column("key").to_numpy()
            t1, t2 = table.column("t1").to_numpy(), table.column("t2").to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])) + 1
            ids, labels, side, full = (table.column(c).to_numpy() for c in ("doc_id", "label", "side", "n_shingles"))
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            low = table.column("low").to_pylist()
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                if (labels[a:b] != labels[a]).any():
                    pairs = emit(ids[a:b], labels[a:b], sigs[a:b], side[a:b], full[a:b], low[a:b])
                    if len(pairs):
                        pairs.sort(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def last(table: pa.Table):
            return tuple(table.column(c)[-1].as_py() for c in ("key", "t1", "t2"))

        for batch in batches:
            if not batch.num_rows:
                continue
            for start in range(0, batch.num_rows, 2 * TILE):
                held.append(batch.slice(start, 2 * TILE))
                table = pa.Table.from_batches(held)
                k = last(table)
                same = np.ones(table.num_rows, bool)
                for c, v in zip(("key", "t1", "t2"), k):
                    same &= table.column(c).to_numpy() == v
                at = int(np.argmax(same))
                yield from flush(table.slice(0, at))
                held = table.slice(at).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long")


def confirm(docs: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |intersection| >= num * |union| of their full shingle sets.

    pairs: a written table.  Texts of second members stream past the set of the first.
    """
    degree = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / PER_SALT).cast("int").alias("salts"))
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "pair-texts")
    degree = written(degree, "pair-degree")
    first = texts.join(degree.hint("merge"), texts.doc_id == degree.a).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    second = pairs.join(degree.hint("merge"), "a").join(texts.withColumnRenamed("doc_id", "b").hint("merge"), "b").select("a", F.pmod(F.hash("b"), "salts").alias("salt"), "b", "text")
    rows = first.unionByName(second).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        held = np.zeros(0, U64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in pieces(batch):
                    x, bounds = shingle_sets(Text.of(part.column("text")), size)
                    good = []
                    for i, b in enumerate(part.column("b").to_pylist()):
                        own = x[bounds[i] : bounds[i + 1]]
                        if b is None:
                            held = own.copy()
                            good.append(False)
                        else:
                            both = len(np.intersect1d(held, own, assume_unique=True))
                            good.append(both > 0 and den * both >= num * (len(held) + len(own) - both))
                    yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = written(rows.mapInArrow(run, "a long, b long"), "links")
    forget(texts)
    forget(degree)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    sk = written(sketches(docs, size), "sketch")
    copies = written(sk.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    member = sk.select("doc_id", "n_shingles", "d1", "d2").join(copies.hint("merge"), ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    # Representatives only: every document that isn't a later copy.
    later = member.where("doc_id <> rep").select("doc_id").distinct()
    reps = sk.where("n_shingles > 0 AND doc_id IS NOT NULL").join(later.hint("merge"), "doc_id", "left_anti")
    band = reps.select(F.explode("keys").alias("key"), "doc_id")
    full = written(band.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("most > least").drop("most"), "buckets")
    rows = written(band.join(full.hint("merge"), "key"), "bucket-rows")
    sigs = reps.select("doc_id", "sig")

    def signed(pairs: DataFrame) -> DataFrame:
        out = pairs
        for c in ("a", "b"):
            out = out.join(sigs.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}")).hint("merge"), c)
        return out.select("a", "b", "sig_a", "sig_b")

    star = rows.where("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = confirm(docs, written(_agree(signed(star)), "pairs"), size, num, den)
    label = written(components(first), "labels")

    # Buckets that still hold several components.
    marked = rows.select("key", "doc_id", "n").join(label.select(F.col("node").alias("doc_id"), "component").hint("merge"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"))
    marked = written(marked, "bucket-labels")
    mixed = written(marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "mixed")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.hash("doc_id"), tiles)
    spread = marked.join(mixed.hint("merge"), "key").join(reps.select("doc_id", "n_shingles", "sig", "low").hint("merge"), "doc_id").withColumn("own", own)
    spread = spread.select("key", "doc_id", "label", "n_shingles", "sig", "low", "own", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    spread = spread.select("key", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "doc_id", "label", "n_shingles", "sig", "low")
    spread = spread.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "side", "doc_id")
    more = written(_tiles(spread, num, den).distinct(), "pairs")
    links = confirm(docs, more, size, num, den)
    joined = links
    for c in ("a", "b"):
        joined = joined.join(label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")).hint("merge"), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    joined = joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    upper = written(components(joined), "labels").select(F.col("node").alias("component"), F.col("component").alias("top"))
    every = label.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("top"))
    lone = upper.join(label.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), "top")
    final = written(every.unionByName(lone), "labels")
    out = member.join(final.select(F.col("node").alias("rep"), "top").hint("merge"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("top", "rep").alias("component_id"))
    for t in (full, rows, first, label, marked, mixed, more, links):
        forget(t)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """Pipeline form: one document of each group of near duplicates, with the columns of docs."""
    gone = near_duplicates(docs, size).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
