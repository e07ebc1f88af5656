"""Numpy kernels over Arrow string buffers, shared by the operators.

Texts are handled as the UTF-8 bytes Arrow already holds: word boundaries,
word hashes and document ids of a whole batch come from a few array passes,
so no Python string is made per word.  Batches are cut into pieces of a
bounded number of bytes, because each pass needs several 8-byte arrays a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 2 << 20
_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n well-spread 64-bit values that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * _BASE + U64(seed))


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z alone are lower-cased

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
#: 0-9, A-Z, a-z and every byte of a code point above 0x7F
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: ASCII letters and every byte of a code point above 0x7F
LETTERISH = ALNUM.copy()
LETTERISH[48:58] = False

#: Longer strings are hashed one by one.
LONG = 64
#: Positions whose window hashes are made at once.
RUN = 1 << 15


def eights(data: np.ndarray) -> np.ndarray:
    """For every position and the one after the last, the 8 bytes from it on as a number; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end].

    Eight bytes at a time go through the mixer, which keeps strings of one
    length of up to eight bytes apart for certain; nothing in a chain of mixers
    is linear, so no texts collide by their structure.  Strings of more than
    LONG bytes get eight bytes of BLAKE2.
    """
    loads, length = eights(data), end - start
    h = mix(length.astype(U64) * _BASE + U64(1))
    live = np.flatnonzero(length > 0)
    for k in range(0, LONG, 8):
        if not len(live):
            break
        rest = np.minimum(length[live] - k, 8).astype(U64)
        h[live] = mix(h[live] ^ (loads[start[live] + k] & (~U64(0) >> (U64(64) - U64(8) * rest))))
        live = live[length[live] > k + 8]
    for i in live.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def windows(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, the 64-bit hashes of all windows of so many bytes, in rising order of lengths.

    Hashes of 8 bytes are doubled: a window is two overlapping ones of the
    greatest power of two that fits.  The data is taken in runs that fit the cache.
    """
    lengths = tuple(sorted(lengths))
    out: list[list[np.ndarray]] = [[] for _ in lengths]
    for at in range(0, max(len(data), 1), RUN):
        own = data[at : at + RUN + lengths[-1] - 1]
        for found, h in zip(out, _windows(own, lengths)):
            found.append(h[:RUN])
    return [np.concatenate(found) for found in out]


def _windows(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    out, width, now = [], 8, mix(eights(data)[: max(0, len(data) - 7)])
    for length in lengths:
        n = max(0, len(data) - length + 1)
        if length < 8:
            out.append(mix(eights(data)[:n] & (~U64(0) >> U64(64 - 8 * length))))
            continue
        while 2 * width <= length:
            now = mix(now[:-width] * _BASE + now[width:]) if len(now) > width else now[:0]
            width *= 2
        out.append(mix(now[:n] * _BASE + now[length - width : length - width + n] + U64(length)))
    return out


class Text:
    """The bytes of a column: data, and offsets of len(column) + 1."""

    __slots__ = ("data", "offsets", "null")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, null: np.ndarray):
        self.data, self.offsets, self.null = data, offsets, null

    @classmethod
    def of(cls, column: pa.Array) -> Text:
        """Nulls are read as empty texts."""
        n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        null = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
        if n == 0:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64), null)
        bufs = column.buffers()
        off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
        return cls(raw, off - off[0], null)

    @classmethod
    def of_strings(cls, texts: list[str | None]) -> Text:
        return cls.of(pa.array(texts, pa.large_string()))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def word_bounds(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document index) of each maximal run of table's bytes."""
        inside = table[self.data]
        n = len(inside)
        if n == 0:
            return (np.zeros(0, np.int64),) * 3
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | first[1:n]
        s = np.flatnonzero(start)
        return s, np.flatnonzero(end) + 1, np.searchsorted(self.offsets, s, side="right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
        """64-bit hashes of data[start:end], with A-Z lower-cased if fold."""
        return string_hashes(FOLD[self.data] if fold else self.data, start, end)

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end, document index) of each word."""
        s, e, d = self.word_bounds(table)
        return self.hashes(s, e), s, e, d


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about limit bytes; one longer text is a slice of its own."""
    off = Text.of(batch.column(column)).offsets
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position within the owner) for owners with so many entries each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def distinct_words(text: Text, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[Text, np.ndarray]:
    """(the distinct words, each as <word> in folded bytes; for each occurrence, which of them it is)."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    s, length = start[first], (end - start)[first] + 2
    owner, k = ragged(length)
    inner = (k > 0) & (k < length[owner] - 1)
    data = np.full(len(owner), 0x3C, np.uint8)  # <
    data[inner] = FOLD[text.data[s[owner[inner]] + k[inner] - 1]]
    data[(k > 0) & ~inner] = 0x3E  # >
    offsets = np.zeros(len(s) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    return Text(data, offsets, np.zeros(len(s), bool)), which


def byte_ngrams(words: Text, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every byte n-gram of the words, ordered by word; buckets are 2**bits hash values."""
    doc = np.repeat(np.arange(len(words)), np.diff(words.offsets))
    at = np.arange(len(doc))
    owners, buckets = [], []
    for n in orders:
        s = at[at + n <= words.offsets[doc + 1]]
        h = words.hashes(s, s + n, fold=False)
        owners.append(doc[s])
        buckets.append((mix(h + U64(n)) >> U64(64 - bits)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values (rows) between consecutive bounds; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def has_letter(text: Text) -> np.ndarray:
    """Whether each text has a code point that is a letter."""
    ascii_letter = LETTERISH & (np.arange(256) < 128)
    counts = np.concatenate([[0], np.cumsum(ascii_letter[text.data])])
    out = counts[text.offsets[1:]] > counts[text.offsets[:-1]]
    for d in np.flatnonzero(~out & (np.diff(text.offsets) > 0)):
        own = text.data[text.offsets[d] : text.offsets[d + 1]]
        out[d] = (own > 127).any() and any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))
    return out
