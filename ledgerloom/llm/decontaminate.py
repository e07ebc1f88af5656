"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of `size` consecutive words of a benchmark item, or the
whole item if it has fewer words.  Patterns of one length m are searched
together.  The shift table holds, for the hash of each block of two words, how
far the block's last occurrence in any pattern lies from the pattern's end;
blocks in no pattern skip m - 1 positions.  Where the shift is 0, the block's
bucket holds the patterns that end with it, and all m words are compared, by
hash and at the end byte by byte.
Texts are searched in many lanes at once: each lane is a run of `LANE` end
positions with its own cursor, so skipping stays a few array operations.

The benchmark is cut into blocks of at most `block_patterns` patterns, so that
what is sent to the executors has a fixed bound.  Each block is searched against
all documents in a pass without a shuffle; before the next block is sent, the
findings are written and the block before is taken from the executors.

Defined results: a null or wordless text has no hits; an item without words
(or null) has no pattern; repeated items count once for each item_id, null ids
are ignored; repeated rows are searched row by row; an empty benchmark hits
nothing, and an empty table gives no rows; overlapping and tied hits are merged
to intervals; a very long text is searched whole by one task, and a very long
item's patterns go to several blocks; clashing columns of the input are kept by `find` under their
names, its own come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import forget, written
from .kernel import ALNUM, FOLD, U64, Text, mix, pieces, ragged

WINDOW = 10
BLOCK_PATTERNS = 500_000
LANE = 128
TABLE_BITS = 20

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class WuManber:
    """Patterns of one length, ready to be searched in word hashes."""

    def __init__(self, patterns: np.ndarray):
        """patterns: distinct rows of m word hashes."""
        self.m = m = patterns.shape[1]
        self.block = min(2, m)
        blocks = patterns if m == 1 else self._blocks(patterns[:, :-1], patterns[:, 1:])
        far = m - self.block
        self.shift = np.full(1 << TABLE_BITS, far + 1, np.int16)
        for j in range(far + 1):  # later blocks are nearer the end: the smallest shift stays
            np.minimum.at(self.shift, self._slot(blocks[:, j]), far - j)
        order = np.argsort(blocks[:, far], kind="stable")
        self.suffix, self.patterns, self.number = blocks[order, far], patterns[order], order

    @staticmethod
    def _blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * U64(0xD6E8FEB86659FD93) + b)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of each occurrence.

        words: hashes of all texts, one after another; last: for each word,
        whether at least m - 1 words of its own text stand before it.
        """
        ends = np.flatnonzero(last)
        if not len(ends):
            return ends, ends
        blocks = words if self.m == 1 else np.concatenate([words[:1], self._blocks(words[:-1], words[1:])])
        shifts = self.shift[self._slot(blocks)]
        n = len(words)
        cursor = np.arange(0, n, LANE)
        stop = np.minimum(cursor + LANE, n)
        found = []
        while len(cursor):
            skip = shifts[cursor]
            found.append(cursor[skip == 0])
            cursor = cursor + np.maximum(skip, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        at = np.concatenate(found)
        at = at[last[at]]
        lo, hi = np.searchsorted(self.suffix, blocks[at], "left"), np.searchsorted(self.suffix, blocks[at], "right")
        ends, numbers = [], []
        for part in np.array_split(np.arange(len(at)), max(1, int((hi - lo).sum()) * self.m // 2_000_000)):
            owner, k = ragged(hi[part] - lo[part])
            e, p = at[part][owner], lo[part][owner] + k
            same = np.ones(len(e), bool)
            for j in range(self.m):  # direct comparison, from the far end of the window
                same[same] = words[e[same] - (self.m - 1 - j)] == self.patterns[p[same], j]
            ends.append(e[same])
            numbers.append(self.number[p[same]])
        return np.concatenate(ends), np.concatenate(numbers)


class Window(NamedTuple):
    """A pattern: the hashes of its words, and the words themselves, each followed by a zero byte."""

    hashes: bytes
    words: bytes


def item_windows(texts: list[str | None], size: int) -> Iterator[Iterator[Window]]:
    """The windows of each text, made one by one: take a text's before the next text's."""
    text = Text.of_strings(texts)
    h, s, e, d = text.words(ALNUM)
    raw = FOLD[text.data].tobytes()
    bounds = np.searchsorted(d, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        spelled = [raw[x:y] + b"\0" for x, y in zip(s[a:b].tolist(), e[a:b].tolist())]
        m = min(size, b - a)
        yield (Window(h[a + k : a + k + m].tobytes(), b"".join(spelled[k : k + m])) for k in range(b - a - m + 1 if m else 0))  # noqa: B023


class Block:
    """A bounded share of the benchmark: one searcher for each length and the items of each pattern."""

    def __init__(self):
        self.seen: dict[Window, list[str]] = {}
        self.entries = 0

    def add(self, item: str, windows: Iterable[Window]) -> None:
        for w in windows:
            self.seen.setdefault(w, []).append(item)
            self.entries += 1

    def close(self) -> Block:
        by: dict[int, list[Window]] = {}
        for w in self.seen:
            by.setdefault(len(w.hashes) // 8, []).append(w)
        self.parts = []
        for m, keys in sorted(by.items()):
            rows = np.frombuffer(b"".join(w.hashes for w in keys), U64).reshape(-1, m)
            self.parts.append((rows, Text.of(pa.array([w.words for w in keys], pa.large_binary())), [sorted(set(self.seen[w])) for w in keys]))
        del self.seen
        return self

    def ready(self) -> list[tuple[WuManber, Text, list[list[str]]]]:
        """Tables are built where they are used: only patterns travel."""
        if not hasattr(self, "built"):
            self.built = [(WuManber(rows), words, items) for rows, words, items in self.parts]
        return self.built


def same_words(text: Text, start: np.ndarray, end: np.ndarray, first: np.ndarray, m: int, patterns: Text, which: np.ndarray) -> np.ndarray:
    """Whether the m words from word `first` on are the pattern's, byte for byte."""
    place, same = first[:, None] + np.arange(m), np.ones(len(first), bool)
    length = end[place] - start[place]
    at = patterns.offsets[which][:, None] + np.cumsum(length + 1, axis=1) - length - 1
    same &= at[:, -1] + length[:, -1] + 1 == patterns.offsets[which + 1] if len(first) else same
    for part in np.array_split(np.flatnonzero(same), max(1, int(length[same].sum()) // 4_000_000)):
        owner, k = ragged(length[part].ravel())
        equal = FOLD[text.data[start[place[part]].ravel()[owner] + k]] == patterns.data[at[part].ravel()[owner] + k]
        ends = patterns.data[(at + length)[part].ravel()] == 0  # each word ends where the pattern's does
        bad = np.concatenate([owner[~equal], np.flatnonzero(~ends)]) // m
        same[part[bad]] = False
    return same


def blocks(benchmark: DataFrame, size: int = WINDOW, block_patterns: int = BLOCK_PATTERNS, item: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The benchmark's patterns, streamed to the driver row by row and handed on in blocks of at most block_patterns (pattern, item) pairs, wherever in an item that falls."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").toLocalIterator()
    block = Block()
    for r in rows:
        for windows in item_windows([r.t], size):
            for w in windows:
                block.add(r.i, (w,))
                if block.entries >= block_patterns:
                    yield block.close()
                    block = Block()
    if block.seen:
        yield block.close()


def search_batch(text: Text, block: Block | None) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Words of each document, its merged word intervals that are hit, and the items that occur in it."""
    n = len(text)
    words, start, end, doc = text.words(ALNUM)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    place = np.arange(len(words)) - bounds[doc] if len(words) else np.zeros(0, np.int64)
    cover = np.zeros(len(words) + 1, np.int64)
    for search, patterns, names in block.ready() if block and len(words) else []:
        ends, which = search.search(words, place >= search.m - 1)
        true = same_words(text, start, end, ends - (search.m - 1), search.m, patterns, which)
        ends, which = ends[true], which[true]
        np.add.at(cover, ends - (search.m - 1), 1)
        np.add.at(cover, ends + 1, -1)
        for d, p in set(zip(doc[ends].tolist(), which.tolist())):
            items[d].update(names[p])
    hit = np.cumsum(cover[:-1]) > 0
    if hit.any():
        edge = np.zeros(len(hit) + 1, bool)
        edge[bounds] = True
        lo = np.flatnonzero(hit & (np.r_[True, ~hit[:-1]] | edge[:-1]))
        hi = np.flatnonzero(hit & (np.r_[~hit[1:], True] | edge[1:])) + 1
        for d, a, b in zip(doc[lo].tolist(), lo.tolist(), hi.tolist()):
            spans[d].append((a - int(bounds[d]), b - int(bounds[d])))
    return np.diff(bounds), spans, items


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", out: str = "contamination", block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """docs with a struct column `out`: n_words, hits (word intervals) and items (ids, sorted as strings)."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, HITS)])
    arrow_out = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def one(block_cast, first):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = block_cast.value if block_cast is not None else None
            for batch in batches:
                for part in pieces(batch, text):
                    n_words, spans, items = search_batch(Text.of(part.column(text)), block)
                    before = [{"hits": [], "items": []}] * part.num_rows if first else part.column(out).to_pylist()
                    found = [
                        {
                            "n_words": int(n),
                            "hits": [{"start": a, "end": b} for a, b in (merge([(x["start"], x["end"]) for x in old["hits"]], s) if old["hits"] else s)],
                            "items": sorted(i.union(old["items"])),
                        }
                        for n, s, i, old in zip(n_words, spans, items, before)
                    ]
                    names = [f.name for f in schema.fields[:-1]]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, arrow_out)], names=[*names, out])

        return run

    frame, held, stored = docs, None, None
    for block in blocks(benchmark, size, block_patterns):
        if held is not None:  # one block at a time is in the executors' memory
            frame = written(frame, "contamination")
            held.unpersist()
            if stored is not None:
                forget(stored)
            stored = frame
        first, held = held is None, docs.sparkSession.sparkContext.broadcast(block)
        frame = frame.mapInArrow(one(held, first), schema)
    return frame.mapInArrow(one(None, True), schema) if held is None else frame


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def summary(found: DataFrame, key: str = "doc_id", out: str = "contamination") -> DataFrame:
    """One row for each document: counts, the digest of its item ids, and whether it is contaminated."""
    hit = F.aggregate(f"{out}.hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        key,
        F.col(f"{out}.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(f"{out}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{out}.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Pipeline form: the documents in which no benchmark window occurs, with their own columns."""
    return find(docs, benchmark, size).where(F.size("contamination.hits") == 0).select(*docs.columns)
