"""Repeated passages by suffix ranks within winnowed anchors.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere
(`keep_first` spares the first occurrence in order of document and position).
The suffix array of a whole corpus has no place in one task, so suffixes are
first brought together that can match at all:

1. Winnowing picks in each window of LENGTH bytes its smallest GRAM-byte hash,
   the anchor.  Equal windows have equal anchors at equal offsets, so a window
   can only repeat where its anchor's hash occurs again.  A run is a stretch of
   windows of one anchor; its context is the bytes these windows cover.
2. Runs are counted by anchor and by (anchor, context hash), with partial
   aggregation.  Anchors that occur once are done: none of their windows
   repeats.  A context that occurs again is done too: all its windows repeat.
3. What is left are contexts that differ though their anchors agree, at the
   ends of repeated passages.  An anchor's distinct contexts are concatenated
   and their suffixes ranked by prefix doubling up to LENGTH.  In suffix order,
   a position's previous and next smaller positions are its nearest earlier
   occurrences: they give the longest-previous-factor array, and the same over
   mirrored positions the longest match that starts later.  A window repeats
   where either reaches LENGTH (with `keep_first`: the former).
4. An anchor of more than GROUP distinct contexts (one very common passage)
   is never brought to one task.  Its contexts are dealt to chunks; each chunk
   finds its repeats by the same arrays and asks only for the first of each
   run of equal windows.  Partial counts are summed for each (anchor, window
   hash), and hashes that occur in several chunks return to those that asked.
   Before that, the bytes common to BLOCK windows at equal offsets from the
   anchor are counted in the same way: where they occur once, none of these
   windows repeats, and none is asked for.  This is exact for every number of
   contexts.

Contexts and passages are compared on whole texts, and only run descriptors
(about one for 150 bytes) and the contexts of step 3 and 4 are exchanged, with
two merge joins that bring texts to their runs and to their results.  A context
is told from others of its anchor by 128 bits of hashes in all (64 of the
anchor, 64 of the context); within a task, bytes are compared.

Defined results: null, empty and short texts lose nothing; rows that repeat a
doc_id with one text are copies of each other; a null doc_id is allowed; an
empty table gives no rows; ties of position are broken by (doc_id, row hash,
offset); columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import forget, written
from .kernel import U64, Text, mix, pieces, windows

LENGTH = 400
GRAM = 100
GROUP = 500
TASK_CONTEXTS = 20_000
BATCH_BYTES = 1 << 18
CHUNK = 256
BLOCK = 16
_LOW = 22


# --- suffix order -----------------------------------------------------------


def rank_levels(symbols: np.ndarray, limit: int) -> list[tuple[int, np.ndarray]]:
    """[(h, ranks of the h-prefixes of all suffixes)] by doubling, up to h = limit; 0 stands for no symbol."""
    n = len(symbols)

    def at(r: np.ndarray, h: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: max(0, n - h)] = r[h:]
        return out

    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    h, levels = 1, [(1, rank)]
    while h < limit:
        step = min(h, limit - h)
        rank = np.unique(rank * (n + 2) + at(rank, step), return_inverse=True)[1].astype(np.int64) + 1
        h += step
        levels.append((h, rank))
    return levels


def suffix_ranks(symbols: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(of each suffix, how many have a smaller limit-prefix; the suffixes that share theirs, in suffix order and then by position).

    Prefix doubling from keys of as many symbols as fit a number; a suffix that
    is alone with its prefix has its final rank and is not sorted again.
    Symbols are above 0.
    """
    n = len(symbols)
    bits = int(symbols.max()).bit_length()
    h = max(1, min(limit, 62 // bits))
    padded = np.concatenate([symbols, np.zeros(h, symbols.dtype)])
    key = padded[:n].astype(np.int64)
    for j in range(1, h):
        key = key << bits | padded[j : j + n]
    rank, live = np.zeros(n + 1, np.int64), np.arange(n)
    rank[n] = -1  # of the empty suffix
    while True:
        order = np.argsort(key)
        live, key, old = live[order], key[order], rank[live[order]]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        before = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))  # first of each group of the shorter prefix
        parent = before[np.searchsorted(before, start, side="right") - 1]
        rank[live] = (old[start] + start - parent)[group]
        live = live[np.diff(np.append(start, len(live)))[group] > 1]
        if h >= limit or not len(live):
            return rank[:n], live[np.lexsort((live, rank[live]))]
        step = min(h, limit - h)
        key = rank[live] * (n + 2) + rank[np.minimum(live + step, n)] + 1
        h += step


def smaller(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the previous and of the next smaller value (-1: none), by pointer jumping."""

    def previous(v: np.ndarray) -> np.ndarray:
        link = np.arange(-1, len(v) - 1)
        todo = np.arange(len(v))
        while len(todo):
            j = link[todo]
            todo = todo[(j >= 0) & (v[j] > v[todo])]
            link[todo] = link[link[todo]]
        return link

    after = len(order) - 1 - previous(order[::-1])[::-1]
    return previous(order), np.where(after >= len(order), -1, after)


def longest_previous(symbols: np.ndarray, limit: int, mirrored: bool = False) -> np.ndarray:
    """For each position, the longest match (up to limit) with an earlier position; if mirrored, with a later one."""
    levels = rank_levels(symbols, limit)
    full = levels[-1][1]
    sa = np.argsort(full, kind="stable")
    out = np.zeros(len(sa), np.int64)
    for i, other in linked(sa, mirrored):
        common = np.where(full[i] == full[other], limit, 0)
        part = np.flatnonzero(common == 0)
        common[part] = common_prefix(levels, i[part], other[part], limit)
        out[i] = np.maximum(out[i], common)
    return out


def linked(sa: np.ndarray, mirrored: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, the nearest earlier ones before them in suffix order), then after them; if mirrored, the nearest later ones."""
    for link in smaller(-sa if mirrored else sa):
        k = np.flatnonzero(link >= 0)
        yield sa[k], sa[link[k]]


def full_matches(rank: np.ndarray, shared: np.ndarray, mirrored: bool = False) -> np.ndarray:
    """Where longest_previous reaches its limit, from suffix_ranks up to there: only suffixes that share their prefix can."""
    out = np.zeros(len(rank), bool)
    for i, other in linked(shared, mirrored):
        out[i] |= rank[i] == rank[other]
    return out


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Lengths (under limit) of the common prefixes of suffixes a and b, from their ranks."""
    n, length = len(levels[0][1]), np.zeros(len(a), np.int64)
    for h, rank in reversed(levels[:-1]):
        while True:
            inside = (a + length < n) & (b + length < n)
            same = np.zeros(len(a), bool)
            same[inside] = rank[(a + length)[inside]] == rank[(b + length)[inside]]
            same &= length + h <= limit
            if not same.any():
                break
            length[same] += h
    return length


def repeats(contexts: list[np.ndarray], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context, which positions have an equal string of `length` earlier, and which have one later."""
    parts, starts, at = [], [], 0
    for k, c in enumerate(contexts):
        starts.append(at)
        parts += [c.astype(np.int64) + 1, np.array([257 + k])]  # each context ends in a symbol of its own
        at += len(c) + 1
    rank, shared = suffix_ranks(np.concatenate(parts), length)
    earlier, later = (full_matches(rank, shared, mirrored) for mirrored in (False, True))
    return [earlier[s : s + len(c)] for s, c in zip(starts, contexts)], [later[s : s + len(c)] for s, c in zip(starts, contexts)]


# --- winnowing --------------------------------------------------------------


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values, from block-wise running minima."""
    n = len(x)
    if n < w:
        return x[:0]
    full = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(text: Text, length: int, gram: int) -> dict[str, np.ndarray]:
    """The runs of all texts: document, first and last window start and anchor (byte positions in data), hashes."""
    n = len(text.data)
    names = ("doc", "first", "last", "at", "anchor", "context")
    if n < length:
        return {k: np.zeros(0, np.int64) for k in names}
    grams, whole = windows(text.data, (gram, length))
    w, mask = length - gram + 1, U64((1 << _LOW) - 1)
    anchor = np.empty(n - length + 1, np.int64)
    for a in range(0, len(anchor), (1 << _LOW) - w):  # positions must fit into the low bits
        part = grams[a : a + (1 << _LOW)]
        least = sliding_least((part & ~mask) | np.arange(len(part), dtype=U64), w)[: (1 << _LOW) - w]
        anchor[a : a + len(least)] = (least & mask).astype(np.int64) + a
    start = np.arange(len(anchor))
    doc = np.searchsorted(text.offsets, start, side="right") - 1
    valid = start + length <= text.offsets[doc + 1]
    start, anchor, doc = start[valid], anchor[valid], doc[valid]
    if not len(start):
        return {k: np.zeros(0, np.int64) for k in names}
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
    first, last, at = start[lo], start[hi], anchor[lo]
    context = mix(mix(whole[first] + (at - first).astype(U64)) ^ (whole[last] + (last - first).astype(U64)))  # the two windows cover it
    return {"doc": doc[lo], "first": first, "last": last, "at": at, "anchor": grams[at].view(np.int64), "context": context.view(np.int64)}


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row tells rows apart unless id and text agree."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


RUN = "anchor long, context long, row long, doc_id long, first long, last long, at long"


def all_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in pieces(batch):
                    text = Text.of(part.column("text"))
                    r = runs(text, length, gram)
                    base = text.offsets[r["doc"]]
                    take = pa.array(r["doc"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r["anchor"]), pa.array(r["context"]), part.column("row").take(take), part.column("doc_id").take(take), *(pa.array(r[c] - base) for c in ("first", "last", "at"))],
                        names=["anchor", "context", "row", "doc_id", "first", "last", "at"],
                    )

    return rows.mapInArrow(run, RUN)


# --- contexts ---------------------------------------------------------------

SPAN = "row long, first long, last long"


def _cut_out(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (row, anchor, groups, first, last, at, doc_id) with the bytes of each context."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "groups", "first", "last", "at", "doc_id")).alias("runs"))
    joined = rows.select("row", "text").join(lists.hint("merge"), "row")

    def run(batches):
        names = ("anchor", "groups", "first", "last", "at", "doc_id")
        for batch in batches:
            for part in pieces(batch):
                text = Text.of(part.column("text"))
                lists = part.column("runs")
                counts = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                owner = np.repeat(np.arange(part.num_rows), counts)
                cols = {c: flat.field(c) for c in names}
                s = text.offsets[owner] + cols["first"].to_numpy()
                e = text.offsets[owner] + cols["last"].to_numpy() + length
                raw = text.data.tobytes()
                bytes_ = pa.array([raw[a:b] for a, b in zip(s.tolist(), e.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(owner)), *cols.values(), bytes_], names=["row", *names, "bytes"])

    return joined.mapInArrow(run, "row long, anchor long, groups long, first long, last long, at long, doc_id long, bytes binary")


def _spans(row: int, first: int, flags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield row, first + a, first + b - 1


def _small_groups(contexts: DataFrame, tasks: int, length: int, keep_first: bool) -> DataFrame:
    dealt = contexts.repartition(tasks, "anchor").sortWithinPartitions("anchor", "doc_id", "row", "at")

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            earlier, later = repeats([np.frombuffer(r[4], np.uint8) for r in rows], length)
            out = []
            for r, a, b in zip(rows, earlier, later):
                n = r[3] - r[2] + 1
                out += _spans(r[1], r[2], a[:n] if keep_first else a[:n] | b[:n])
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "first", "last"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "row", "first", "last", "bytes"))):
                if size > BATCH_BYTES and r[0] != held[-1][0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield from flush(held)

    return dealt.mapInArrow(run, SPAN)


def window_hashes(raw: list[bytes], length: int) -> list[np.ndarray]:
    """Of each string, the hashes of its windows."""
    found = windows(np.frombuffer(b"".join(raw), np.uint8), (length,))[0]
    end = np.cumsum([len(r) for r in raw]).tolist()
    return [found[e - len(r) : e - length + 1] for r, e in zip(raw, end)]


CHUNKED = ("key", "anchor", "doc_id", "row", "at", "first", "bytes")


def _large_groups(contexts: DataFrame, length: int, keep_first: bool) -> tuple[DataFrame, list[DataFrame]]:
    """As _small_groups, for anchors of very many contexts, without bringing them together; and the tables to forget after."""
    chunk = F.pmod(F.xxhash64("row", "at"), F.greatest(F.lit(1), F.ceil(F.col("groups") / CHUNK)))
    chunked = written(contexts.withColumn("key", F.xxhash64("anchor", chunk)).select(*CHUNKED), "chunks")
    step = min(BLOCK, length)
    core = length - step + 1

    def groups(batches, columns):
        held = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in columns)):
                if held and held[-1][0] != r[0]:
                    yield held
                    held = []
                held.append(r)
        if held:
            yield held

    def blocks(own: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(block of each window, hash of what each block's windows have in common) of each context."""
        out = []
        for r, h in zip(own, window_hashes([r[6] for r in own], core)):
            n, x = len(r[6]) - length + 1, r[4] - r[5]
            block = (x - np.arange(n)) // step
            b = np.arange(block[-1], block[0] + 1)
            out.append((block - b[0], mix(h[x - b * step] + b.astype(U64))))
        return out

    def ask_cores(batches):
        with np.errstate(over="ignore"):
            for own in groups(batches, CHUNKED):
                value, count = np.unique(np.concatenate([c for _, c in blocks(own)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([own[0][0]] * len(value), pa.int64()), pa.array([own[0][1]] * len(value), pa.int64()), pa.array(value.view(np.int64)), pa.array(count)], names=["key", "anchor", "core", "n"])

    def with_answers(answers: DataFrame) -> DataFrame:
        """The chunks' contexts, and before them, as rows without bytes, what was found for the chunk."""
        both = chunked.withColumn("hash", F.lit(None).cast("long")).unionByName(answers, allowMissingColumns=True)
        return both.repartition("key").sortWithinPartitions("key")

    def split(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        return [r for r in rows if r[6] is not None], [r for r in rows if r[6] is None]

    def ask(batches):
        """The first of each run of equal windows of a chunk, where it may repeat elsewhere, and whether the run has more."""
        with np.errstate(over="ignore"):
            for rows in groups(batches, (*CHUNKED, "hash")):
                own, again = split(rows)
                if not again:
                    continue
                own.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[4]))
                again = np.array([r[7] for r in again], np.int64).view(U64)
                hopeful = [np.isin(c, again)[block] for block, c in blocks(own)]
                own, hopeful = [r for r, x in zip(own, hopeful) if x.any()], [x for x in hopeful if x.any()]
                earlier, later = repeats([np.frombuffer(r[6], np.uint8) for r in own], length)
                h, n, who = [], [], []
                for k, (r, x, a, b, w) in enumerate(zip(own, hopeful, earlier, later, window_hashes([r[6] for r in own], length))):
                    lead = x & ~a[: len(x)]
                    h.append(w[lead])
                    n.append(1 + b[: len(x)][lead].astype(np.int64))
                    who += [k] * int(lead.sum())
                lead = [own[k] for k in who]
                ids = (pa.array([r[c] for r in lead], pa.int64()) for c in (0, 1, 2, 3, 4))
                key, anchor, *place = ids
                yield pa.RecordBatch.from_arrays([key, anchor, pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(n)), *place], names=["key", "anchor", "window", "n", "doc_id", "row", "at"])

    by_chunk = chunked.repartition("key").sortWithinPartitions("key")
    cores = written(by_chunk.mapInArrow(ask_cores, "key long, anchor long, core long, n long"), "cores")
    twice = written(cores.groupBy("anchor", "core").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "core"), "cores-again")
    hopeful = cores.join(twice.hint("merge"), ["anchor", "core"]).select("key", F.col("core").alias("hash"))
    asked = written(with_answers(hopeful).mapInArrow(ask, "key long, anchor long, window long, n long, doc_id long, row long, at long"), "windows")
    again = written(asked.groupBy("anchor", "window").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "row", "at")).alias("lead")).where("n > 1").select("anchor", "window", "lead.*"), "windows-again")
    answers = asked.select("key", "anchor", "window").join(again.hint("merge"), ["anchor", "window"]).select("key", F.col("window").alias("hash"), "doc_id", "row", "at")

    def answer(batches):
        with np.errstate(over="ignore"):
            for rows in groups(batches, (*CHUNKED, "hash")):
                own, found = split(rows)
                if not found:
                    continue
                found.sort(key=lambda r: r[7] % (1 << 64))
                known = np.array([r[7] for r in found], np.int64).view(U64)
                out = []
                for r, h in zip(own, window_hashes([r[6] for r in own], length)):
                    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    flags = known[place] == h
                    if keep_first:
                        flags &= np.array([found[i][2:5] != r[2:5] for i in place.tolist()])
                    out += _spans(r[3], r[5], flags)
                cols = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "first", "last"])

    return with_answers(answers).mapInArrow(answer, SPAN), [chunked, cores, twice, asked, again]


# --- the operator -----------------------------------------------------------


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """(row, first, last): stretches of window starts whose `length` bytes also start elsewhere (earlier, with keep_first)."""
    table = written(all_runs(rows, length, gram), "runs")
    again = written(table.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("n > 1").select("anchor", (F.col("lo") < F.col("hi")).alias("differ")), "anchors")
    shared = written(table.join(again.hint("merge"), "anchor"), "shared-runs")
    forget(table)
    classes = shared.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "at")).alias("lead"))
    classes = written(classes, "classes")
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("groups"), F.min("n").alias("least"))
    sizes = written(sizes.where("groups > 1" if keep_first else "groups > 1 AND least = 1"), "anchor-sizes")
    marked = shared.join(classes.hint("merge"), ["anchor", "context"])
    me = F.struct("doc_id", "row", "at")
    copies = marked.where("n > 1")
    if keep_first:
        copies = copies.where(~me.eqNullSafe(F.col("lead")))
    done = written(copies.select("row", "first", "last"), "repeats")
    # One run of each context that differs from others of its anchor.
    open_ = marked.where(me.eqNullSafe(F.col("lead"))).join(sizes.hint("merge"), "anchor").select("row", "anchor", "groups", "first", "last", "at", "doc_id").dropDuplicates(["row", "anchor", "at"])
    contexts = written(_cut_out(rows, open_, length), "contexts")
    tasks = -(-int(sizes.where(F.col("groups") <= GROUP).agg(F.sum("groups")).first()[0] or 1) // TASK_CONTEXTS)
    small = _small_groups(contexts.where(F.col("groups") <= GROUP), tasks, length, keep_first)
    large, made = _large_groups(contexts.where(F.col("groups") > GROUP), length, keep_first)
    out = written(done.unionByName(small).unionByName(large), "repeats")
    for t in (again, shared, classes, sizes, done, contexts, *made):
        forget(t)
    return out


def removed(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows that start in the spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def dedupe(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row, and the kept bytes if wanted."""
    rows = keyed(docs)
    lists = repeated_windows(rows, length, gram, keep_first).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    joined = rows.join(lists.hint("merge"), "row", "left").select("doc_id", "text", "found")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + (", kept binary" if kept else "")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                text = Text.of(part.column("text"))
                raw = text.data.tobytes()
                out = []
                for i, found in enumerate(part.column("found").to_pylist()):
                    own = raw[text.offsets[i] : text.offsets[i + 1]]
                    cut = removed([(f["first"], f["last"]) for f in found or []], length)
                    parts, at = [], 0
                    for a, b in cut:
                        parts.append(own[at:a])
                        at = b
                    left = b"".join([*parts, own[at:]])
                    out.append((len(own), len(own) - len(left), len(cut), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in cut], left))
                cols = list(zip(*out)) or [[]] * 6
                arrays = [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string(), span_type]))]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
                if kept:
                    arrays.append(pa.array(cols[5], pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, schema)
