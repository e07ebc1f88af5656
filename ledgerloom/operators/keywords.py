"""Which of many keywords a text contains: one pass over each text with an Aho-Corasick automaton.

A join of texts and keywords on `contains` compares every pair.  Here each
task walks a text once through an automaton of all keywords, whatever their
number.  Keywords come from a relation; its size is measured first.  Up to
BLOCK_BYTES they are one broadcast; beyond, they are dealt by hash into blocks
of about so many bytes, each is broadcast and searched by itself, and its hits
are written to the shared folder, so one block is in memory at a time.

Case is folded by the engine's lower() on both sides.  Null and empty keywords
are in no text, a null text has none; repeated keywords count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

BLOCK_BYTES = 2 << 20
_built: list = []  # this worker's last words and their automaton


def automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, w in enumerate(words):
        a.add_word(w, i)
    a.make_automaton()
    return a


def _automaton(shared) -> ahocorasick.Automaton:
    """Built once in a worker process, which serves many tasks and holds one copy of a broadcast."""
    if not _built or _built[0] is not shared.value:
        _built[:] = shared.value, automaton(shared.value)
    return _built[1]


def found(a: ahocorasick.Automaton, text: str | None) -> list[int]:
    """Numbers of the keywords that the text contains, rising."""
    return sorted({i for _, i in a.iter(text)}) if text and len(a) else []


def _scan(texts: DataFrame, words: list[str], text: str, out: str) -> DataFrame:
    """The rows of texts for each of the words that they contain, with the word in place of the text."""
    shared = texts.sparkSession.sparkContext.broadcast(words)
    keep = [f for f in texts.schema.fields if f.name != text]
    low = texts.select(*[f.name for f in keep], F.lower(text).alias(text)).where(F.col(text).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, names = _automaton(shared), pa.array(shared.value, pa.string())
        for batch in batches:
            hits = [found(a, x) for x in batch.column(text).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(hits)), [len(h) for h in hits]))
            which = pa.array(np.array([i for h in hits for i in h], np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(rows) for f in keep), names.take(which)], names=[*(f.name for f in keep), out])

    return low.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` string"]))


def contained(texts: DataFrame, keywords: DataFrame, text: str = "text", keyword: str = "keyword", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """texts join keywords on contains(lower(text), lower(keyword)): the other columns of texts, and the keyword in lower case."""
    spark = texts.sparkSession
    words = keywords.select(F.lower(keyword).alias("w")).where("w <> ''").distinct()
    size = words.agg(F.coalesce(F.sum(F.octet_length("w")), F.lit(0)).alias("n")).first().n
    if size <= block_bytes:
        return _scan(texts, sorted(r.w for r in words.collect()), text, keyword)
    blocks = -(-size // block_bytes)
    folder = shared_folder(spark, "keywords")
    words.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(f"{folder}/words")
    dealt = spark.read.parquet(f"{folder}/words")
    for b in range(blocks):
        own = sorted(r.w for r in dealt.where(F.col("block") == b).select("w").collect())
        _scan(texts, own, text, keyword).write.mode("append").parquet(f"{folder}/hits")
    return spark.read.schema(_scan(texts, [], text, keyword).schema).parquet(f"{folder}/hits")


def masks(texts: DataFrame, bits: dict[str, int], words: int, text: str = "text", width: int = 62) -> DataFrame:
    """texts with columns _b0.. in place of the text: bit bits[k] % width of number bits[k] // width is set if it contains k."""
    listed = sorted(k.lower() for k in bits if k)
    shared = texts.sparkSession.sparkContext.broadcast(listed)
    keep = [f for f in texts.schema.fields if f.name != text]
    place = [bits[k] for k in listed]
    always = [b for k, b in bits.items() if not k]
    low = texts.select(*[f.name for f in keep], F.lower(text).alias(text)).where(F.col(text).isNotNull())
    names = [f"_b{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(shared)
        for batch in batches:
            out = np.zeros((words, batch.num_rows), np.int64)
            for row, x in enumerate(batch.column(text).to_pylist()):
                for b in [*always, *(place[i] for i in found(a, x))]:
                    out[b // width, row] |= 1 << (b % width)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *(pa.array(c) for c in out)], names=[*(f.name for f in keep), *names])

    return low.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{n} long" for n in names)]))
