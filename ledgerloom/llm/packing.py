"""Hierarchical multi-length packing of tokenized documents.

Documents are tokenized, closed by an end id and routed to context-size tiers
(512 to 4096 tokens): whole windows of the largest tier are cut from long
documents, what is left goes to the smallest tier that holds it.  Tiers are
packed from the longest to the shortest.  A window is opened by the longest
piece of its tier; its gap is filled with the longest pieces of the shorter
tiers that fit, and at the end by cutting the shortest piece.  So every window
is full, and a window of a shorter tier needs no padding either.  Windows are
then dealt into step groups of equal tokens, longest first, so that each step
mixes tiers to the same total.

Packing runs within the partitions of the scan, over groups of about
GROUP_TOKENS tokens, of which unfinished windows are carried on to the next;
only what remains at a partition's end is cut into powers of two.  Nothing is
shuffled, a task holds one group, and a sequence's id is its partition's
number and its place there, so a task that runs again gives the same ids.

Ids come from the tokenizer itself.  As none of its matches spans white space
or a border of letters and signs, a text's ids are those of its chunks one
after another, and a worker encodes each distinct chunk once (its cache is
cleared beyond CACHE chunks).

Defined results: a null or empty text is the end id alone; repeated rows are
packed one by one; an empty table gives no rows; columns besides doc_id and
text are ignored.  The tokenizer file must be readable on the executors.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import NOT_SPACE, Text, pieces, ragged

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
GROUP_TOKENS = 1 << 20
STEP_TOKENS = 16 * 4096
CACHE = 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kinds() -> np.ndarray:
    """0: ASCII white space, 1: ASCII letter, 2: other ASCII but the apostrophe, 3: the rest."""
    kind = np.full(256, 2, np.uint8)
    kind[128:] = kind[0x27] = 3
    kind[65:91] = kind[97:123] = 1
    kind[~NOT_SPACE] = 0
    return kind


class Encoder:
    """Token ids of whole texts through a cache of their chunks.

    Chunks end at ASCII white space, and where an ASCII letter meets an ASCII
    digit or sign other than an apostrophe: no match of the tokenizer's spans
    either.  Pieces with the beginning of a special token's string are cut at
    white space alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kinds = _kinds()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.offsets, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, text: Text, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = text.data.tobytes()
        found = self.tokenizer.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())], add_special_tokens=False)
        ids = [e.ids for e in found]
        place = len(self.offsets) - 1 + np.arange(len(ids))
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
        self.flat = np.concatenate([self.flat, np.array([x for y in ids for x in y], np.uint32)])
        keys, place = np.concatenate([self.keys, hashes]), np.concatenate([self.place, place])
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], place[order]

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes, at

    def chunks(self, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of each chunk."""
        s, e, doc = text.word_bounds(NOT_SPACE)
        if not len(s) or b"<|" in text.data.tobytes():
            return s, e, doc
        kind = self.kinds[text.data]
        cut = np.flatnonzero((kind[1:] * kind[:-1] == 2)) + 1  # 1 meets 2
        first = np.zeros(len(kind) + 1, bool)
        first[text.offsets] = True
        cut = cut[~first[cut]]
        s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
        return s, e, np.searchsorted(text.offsets, s, side="right") - 1

    def encode(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; offsets by text)."""
        s, e, doc = self.chunks(text)
        h = text.hashes(s, e, fold=False)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self._clear()
        old, at = self._known(distinct)
        if not old.all():
            self._learn(text, distinct[~old], s[first[~old]], e[first[~old]])
            _, at = self._known(distinct)
        at = self.place[at] if len(self.place) else at
        begin, count = self.offsets[at][which], np.diff(self.offsets)[at][which] if len(at) else np.zeros(0, np.int64)
        # One more entry for each text's end id, after its words.
        n = len(text)
        order = np.argsort(np.concatenate([doc, np.arange(n)]), kind="stable")
        count, begin = np.concatenate([count, np.ones(n, np.int64)])[order], np.concatenate([begin, np.full(n, -1)])[order]
        owner, k = ragged(count)
        source = begin[owner] + k
        ids = np.where(begin[owner] < 0, np.uint32(END_ID), self.flat[np.maximum(source, 0)] if len(self.flat) else np.uint32(END_ID)).astype(np.uint32)
        entries = np.searchsorted(np.concatenate([doc, np.arange(n)])[order], np.arange(n + 1))
        return ids, np.concatenate([[0], np.cumsum(count)])[entries]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its tasks share the cache."""
    return Encoder(path)


class Packer:
    """Packs pieces (length, number, start) into full windows; pieces refer to documents by number."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.pool = sorted(tiers), []

    def tier(self, n: int) -> int:
        return self.tiers[bisect.bisect_left(self.tiers, n)]

    def add(self, number: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Whole windows of the longest tier at once; the rest waits in the pool."""
        top, at = self.tiers[-1], 0
        while length - at >= top:
            yield top, [(top, number, at)]
            at += top
        if length > at:
            bisect.insort(self.pool, (length - at, number, at))

    def windows(self, last: bool = False) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(size, pieces) of full windows; what can't fill one stays in the pool unless this is the last call."""
        pool = self.pool
        while pool:
            window = [pool.pop()]
            size = self.tier(window[0][0])
            gap = size - window[0][0]
            while gap and pool:
                i = bisect.bisect_right(pool, (gap, float("inf"), 0)) - 1
                if i >= 0:
                    piece = pool.pop(i)
                else:
                    length, number, start = pool.pop(0)
                    piece = gap, number, start
                    bisect.insort(pool, (length - gap, number, start + gap))
                window.append(piece)
                gap -= piece[0]
            if not gap:
                yield size, window
            elif last:
                yield from self._powers(window)
            else:
                for piece in window:
                    bisect.insort(pool, piece)
                return

    @staticmethod
    def _powers(window: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        total = sum(p[0] for p in window)
        for bit in reversed(range(total.bit_length())):
            need, own = total & (1 << bit), []
            while need:
                length, number, start = window.pop(0)
                take = min(need, length)
                own.append((take, number, start))
                if take < length:
                    window.insert(0, (length - take, number, start + take))
                need -= take
            if own:
                yield 1 << bit, own


def steps(sizes: list[int], budget: int) -> list[int]:
    """The step group of each window of one packing group: longest first, each step filled to the budget."""
    out, room = [0] * len(sizes), [budget]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for step in range(max(0, len(room) - 2), len(room)):
            if room[step] >= sizes[i]:
                break
        else:
            room.append(budget)
            step = len(room) - 1
        room[step] -= sizes[i]
        out[i] = step
    return out


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long"


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, ids: bool = False) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step) and its ids if wanted.

    A sequence holds exactly `tier` tokens: one of the tiers, or at a
    partition's end a smaller power of two.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, packer = encoder(path), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}  # document number -> [key, ids, tokens not yet placed]
        counter = {"doc": 0, "sequence": 0, "step": 0}

        def emit(windows: list) -> pa.RecordBatch:
            group = steps([w[0] for w in windows], step_tokens)
            rows: list[tuple] = []
            for (size, window), step in zip(windows, group):
                at = 0
                for length, number, start in window:
                    key, own, _ = held[number]
                    part = own[start : start + length]
                    rows.append((key, start, length, zlib.crc32(part.tobytes()), len(own), base + counter["sequence"], at, size, base + counter["step"] + step, part.tolist() if ids else None))
                    at += length
                    held[number][2] -= length
                    if not held[number][2]:
                        del held[number]
                counter["sequence"] += 1
            counter["step"] += max(group, default=-1) + 1
            columns = list(zip(*rows)) or [[]] * 10
            kinds = [key_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]
            if ids:
                arrays.append(pa.array(columns[9], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        key_type, tokens, windows = pa.int64(), 0, []
        for batch in batches:
            for part in pieces(batch):
                key_type = part.column("doc_id").type
                flat, offsets = tokens_of.encode(Text.of(part.column("text")))
                for i, key in enumerate(part.column("doc_id").to_pylist()):
                    own = flat[offsets[i] : offsets[i + 1]].copy()
                    held[counter["doc"]] = [key, own, len(own)]
                    windows += packer.add(counter["doc"], len(own))
                    counter["doc"] += 1
                    tokens += len(own)
                if tokens >= GROUP_TOKENS:
                    windows += packer.windows()
                    yield emit(windows)
                    tokens, windows = 0, []
        windows += packer.windows(last=True)
        if windows:
            yield emit(windows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}" + (", ids array<int>" if ids else ""))
