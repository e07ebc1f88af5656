"""Sharding of records by weighted rendezvous hashing, in built-in functions only.

Every shard gets a score for a key, -weight / ln(u) with u in (0, 1) from a
hash of key and shard; the record goes to the highest score.  The score of a
shard depends on nothing but the key, the shard and its weight, so one more
shard takes rows only into itself, and a changed weight moves rows only to or
from that shard.

Nothing of a text crosses the network: a row's size and checksum are worked
out at the scan, and only (key, size, checksum, shard) are exchanged, once, to
number the rows.  The numbering never puts a shard into one task: rows are
dealt over (shard, bucket), counted there with partial aggregation, and each
bucket starts where the earlier buckets of its shard end.

Defined results: a null text counts as empty (size 16, checksum 0); a null key
is a key of its own; repeated rows get a slot each; an empty table gives no
rows; other columns, also those named like an output, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAW = "key"
ROW_OVERHEAD = 16  # bytes a record has besides its text


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard (0-based) that holds a key, among len(weights) weighted shards."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive and finite")
    equal = len(set(weights)) == 1
    # The sign bit goes, 53 bits stay: u is exact as a double, and never 0 or 1.
    def score(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), shard, key), 11)
        if equal:
            return bits
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return -F.element_at(F.array(*[F.lit(float(w)) for w in weights]), shard + 1) / F.ln(u)

    ids = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    best = F.array_max(F.transform(ids, lambda s: F.struct(score(s).alias("score"), (-s).alias("neg"))))
    return (-best["neg"]).cast("int")


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, rows_per_bucket: int = 250_000, seed: int = 0) -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard) of all documents.

    weights: one for each shard, equal if not given; a grown layout adds one
    shard of the mean weight.  rows_per_bucket bounds what one task numbers.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards:
        raise ValueError("one weight for each shard")
    grown = [*weights, sum(weights) / shards]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    k = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    sized = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        k.alias("_k"),
    )
    total = docs.count()
    buckets = max(8, -(-total // (rows_per_bucket * shards)))
    placed = sized.select(
        key,
        "size",
        "text_crc32",
        rendezvous(F.col("_k"), weights, seed).alias("shard"),
        rendezvous(F.col("_k"), grown, seed).alias("grown_shard"),
        F.pmod(F.xxhash64("_k", "text_crc32", "size"), F.lit(buckets)).cast("int").alias("_b"),
    )
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_b").count().select("shard", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_b").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    return (
        placed.withColumn("_n", F.row_number().over(within))
        .join(starts, ["shard", "_b"])
        .select(key, "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("_start") + F.col("_n") - 1).cast("long").alias("slot"), "grown_shard")
    )
