"""Edit distance of whole pages: bit-parallel, in Arrow batches.

The built-in levenshtein fills a table of both lengths' product.  Here a column
of that table is two integers of as many bits as the longer text has code
points (vertical differences, Myers and Hyyro), so a page of 20,000 takes some
20,000 steps on words of 20,000 bits; memory is one column.  What both texts
begin and end with is cut off first.  With a threshold, a block of columns is
followed by a test whether the rest can still stay within it.

Pages that differ little are done before that by the farthest places that 1, 2,
.. edits reach on each diagonal of the table (Ukkonen, Landau and Vishkin): the
work grows with the square of the distance, not with that of the length.  If a
share of FEW of the length in edits doesn't do, the bit-parallel way follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
FEW = 1 / 16


def edit_distance(a: str, b: str, most: int | None = None) -> int | None:
    """Levenshtein distance in code points; None if it is more than `most`."""
    if len(a) < len(b):
        a, b = b, a
    if most is not None and len(a) - len(b) > most:
        return None
    start, end = 0, len(b)
    while start < end and a[start] == b[start]:
        start += 1
    cut = len(a) - len(b)
    while end > start and a[end + cut - 1] == b[end - 1]:
        end -= 1
    a, b = a[start : end + cut], b[start:end]
    if not b:
        return len(a)
    few = int(len(a) * FEW) if most is None else min(int(len(a) * FEW), most)
    found = few_edits(a, b, few)
    if found is not None or few == most:
        return found
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    where = {c: _bits(at, len(a)) for c, at in places.items() if c in set(b)}
    full, last = (1 << len(a)) - 1, len(a) - 1
    plus, minus, score = full, 0, len(a)
    for at in range(0, len(b), BLOCK):
        for c in b[at : at + BLOCK]:
            eq = where.get(c, 0)
            zero = (((eq & plus) + plus) ^ plus) | eq | minus
            right, left = minus | (full & ~(zero | plus)), plus & zero
            score += (right >> last & 1) - (left >> last & 1)
            right, left = (right << 1 | 1) & full, left << 1 & full
            plus, minus = left | (full & ~(zero | right)), right & zero
        if most is not None and score - max(0, len(b) - at - BLOCK) > most:
            return None
    return score


def few_edits(a: str, b: str, most: int) -> int | None:
    """Levenshtein distance of two texts that begin differently; None if it is more than `most`."""
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return None
    # Both end on a sign of their own, so no run of equal signs goes over an end.
    left, right = (np.append(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(0xFFFFFFFE + i)) for i, x in enumerate((a, b)))
    zero = most + 1  # the place of diagonal 0; diagonal k has place i of a beside place i + k of b
    diagonal = np.arange(-zero, zero + 1)
    end = np.minimum(m, n - diagonal)
    reach = np.full(len(diagonal), -(m + n + 2))
    reach[zero] = 0
    for edits in range(1, most + 1):
        lo, hi = zero - min(edits, m), zero + min(edits, n) + 1
        i = np.maximum(np.maximum(reach[lo:hi], reach[lo + 1 : hi + 1]) + 1, reach[lo - 1 : hi - 1])
        np.minimum(i, end[lo:hi], out=i)
        at = np.flatnonzero(left[i] == right[i + diagonal[lo:hi]])
        for _ in range(3):
            if not len(at):
                break
            i[at] += 1
            here = i[at]
            at = at[left[here] == right[here + diagonal[lo:hi][at]]]
        for k in at.tolist():  # the few diagonals along which the texts agree
            i[k] = _agree(a, b, int(i[k]), int(i[k] + diagonal[lo + k]))
        reach[lo:hi] = i
        if reach[zero + n - m] >= m:
            return edits
    return None


def _agree(a: str, b: str, i: int, j: int) -> int:
    """Where in a the run of equal signs ends that begins at a[i] and b[j]."""
    most, size = min(len(a) - i, len(b) - j), 32
    done = 0
    while done < most:
        size = min(size, most - done)
        if a[i + done : i + done + size] == b[j + done : j + done + size]:
            done, size = done + size, size * 2
        elif size == 1:
            break
        else:
            size = max(1, size // 4)
    return i + done


def _bits(at: list[int], n: int) -> int:
    out = bytearray(n // 8 + 1)
    for i in at:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def page_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """As the built-in levenshtein(a, b), for long texts; null if one is null or the distance is more than `most`."""

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([None if x is None or y is None else edit_distance(x, y, most) for x, y in zip(left, right)], dtype="Int32")

    return run(a, b)
