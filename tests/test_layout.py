"""Spatial joins against all pairs, label transfer and reading order against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import layout as L


def tier(w, n):
    (x1, y1, x2, y2), (a, b, c, d) = w, n
    shared = max(0, min(x2, c) - max(x1, a)) * max(0, min(y2, d) - max(y1, b))
    union = (x2 - x1) * (y2 - y1) + (c - a) * (d - b) - shared
    if union > 0 and shared / union >= 0.3:
        return 1
    if x1 <= (a + c) / 2 <= x2 and y1 <= (b + d) / 2 <= y2:
        return 2
    return 3 if a <= (x1 + x2) / 2 <= c and b <= (y1 + y2) / 2 <= d else None


def sample(seed):
    rng = random.Random(seed)

    def box(large):
        x, y = rng.randint(-50, 400), rng.randint(-50, 400)
        return x, y, x + rng.choice([0, 3, 30, large]), y + rng.choice([0, 2, 20, large])

    words = [(p, i, *box(60)) for p in range(3) for i in range(60)] + [(1, 99, 100, 100, 200, 200)]
    notes = [(p, i, rng.choice([*L.PRIORITY, "STAMP", None]), *box(300)) for p in range(3) for i in range(25)] + [(1, 99, "CNIC", 200, 200, 300, 300), (9, 1, "CNIC", 0, 0, 900, 900)]
    near = [(w[0], 200 + w[1], rng.choice([*L.PRIORITY]), *(c + rng.randint(-2, 2) * (k < 2) for k, c in enumerate(w[2:]))) for w in words[::7]]
    return words, notes + [n for n in near if n[3] <= n[5] and n[4] <= n[6]]


W, N = "page long, word long, x1 int, y1 int, x2 int, y2 int", "page long, note long, label string, ax1 int, ay1 int, ax2 int, ay2 int"


@pytest.mark.parametrize("cell", [7, 100, 10_000])
def test_matched_against_all_pairs(spark, cell):
    words, notes = sample(cell)
    got = [(r.page, r.word, r.note, r.tier) for r in L.matched(spark.createDataFrame(words, W), spark.createDataFrame(notes, N), cell).collect()]
    want = []
    for n in notes:
        tiers = {w[1]: tier(w[2:], n[3:]) for w in words if w[0] == n[0]}
        best = min((t for t in tiers.values() if t), default=None)
        want += [(n[0], w, n[1], t) for w, t in tiers.items() if t and t == best]
    assert sorted(got) == sorted(want) and {t for *_, t in want} == {1, 2, 3}


@pytest.mark.parametrize("crowded", [0, 60, 10_000])
def test_few_words_meet_all_notes_and_crowded_pages_meet_by_cell(spark, crowded):
    words, notes = sample(5)  # pages of 60 and 61 words
    w, n = spark.createDataFrame(words, W), spark.createDataFrame(notes, N)
    few, many = L._parts(w, n, 10, crowded)
    assert "Generate" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert ({r.page for r in few.collect()}, {r.page for r in many.collect()}) == {0: (set(), {0, 1, 2}), 60: ({0, 2}, {1}), 10_000: ({0, 1, 2}, set())}[crowded]
    want = [(w[0], w[1], n[1]) for w in words for n in notes if w[0] == n[0] and max(w[2], n[3]) <= min(w[4], n[5]) and max(w[3], n[4]) <= min(w[5], n[6])]
    assert sorted((r.page, r.word, r.note) for r in few.unionByName(many).collect()) == sorted(want)
    assert sorted(map(str, L.matched(w, n, 10, crowded).collect())) == sorted(map(str, L.matched(w, n).collect()))


def test_touching_pairs_come_once_and_from_one_page(spark):
    words, notes = sample(5)
    got = [(r.page, r.word, r.note) for r in L.touching(spark.createDataFrame(words, W), spark.createDataFrame(notes, N), 10).collect()]
    want = [(w[0], w[1], n[1]) for w in words for n in notes if w[0] == n[0] and max(w[2], n[3]) <= min(w[4], n[5]) and max(w[3], n[4]) <= min(w[5], n[6])]
    assert sorted(got) == sorted(want)
    turned = spark.createDataFrame([(0, 1, 50, 50, 10, 10)], W)  # ends before it begins
    assert L.touching(turned, spark.createDataFrame([(0, 1, "CNIC", 0, 0, 99, 99)], N)).count() == 0


def labels(words, notes):
    tags = {w[:2]: "O" for w in words}
    level = {w[:2]: 0 for w in words}
    for n in sorted((n for n in notes if n[2] in L.PRIORITY), key=lambda n: (-L.PRIORITY[n[2]], n[1])):
        tiers = {w: tier(w[2:], n[3:]) for w in words if w[0] == n[0]}
        best = min((t for t in tiers.values() if t), default=None)
        hit = sorted((w for w, t in tiers.items() if t and t == best), key=lambda w: (w[3], w[2], w[0], w[1]))
        for i, w in enumerate(hit):
            if L.PRIORITY[n[2]] > level[w[:2]]:
                tags[w[:2]], level[w[:2]] = ("B-" if i == 0 else "I-") + n[2], L.PRIORITY[n[2]]
    return tags


def test_labels(spark):
    words, notes = sample(8)
    got = {(r.page, r.word): r.tag for r in L.labelled(spark.createDataFrame(words, W), spark.createDataFrame(notes, N), ["page", "word"]).collect()}
    assert got == labels(words, notes) and len({t for t in got.values()}) > 5


def rows(boxes):
    """(row of each box, in its order): the first row with any near box, as the source goes."""
    tolerance = max(10, int(sum(b[3] for b in boxes) / len(boxes) * 0.05))
    found, out = [], []
    for b in boxes:
        c = b[2] + b[3] // 2
        at = next((i for i, r in enumerate(found) if any(abs(c - x) <= tolerance for x in r)), None)
        if at is None:
            at = len(found)
            found.append([])
        found[at].append(c)
        out.append(at)
    return out


def test_reading_order(spark):
    rng = random.Random(2)
    pages = {p: [(p, rng.randint(0, 300), rng.randint(0, 150), rng.choice([8, 20, 41, 700 if p == 3 else 30]), i) for i in range(rng.randint(1, 40))] for p in range(8)}
    pages[8] = [(8, 0, 95, 10, 0), (8, 50, 104, 10, 1), (8, 20, 113, 10, 2)]  # a chain over the edges of any bins
    df = spark.createDataFrame([b for bs in pages.values() for b in bs], "page long, x int, y int, h int, id long").withColumn("w", F.lit(5))
    got = {(r.page, r.id): (r.row, r.pos) for r in L.in_reading_order(df, ["id"], F.col("page") % 2 == 0).collect()}
    for p, boxes in pages.items():
        row = rows(boxes)
        order = sorted(range(len(boxes)), key=lambda i: (row[i], boxes[i][2], boxes[i][1] * (-1 if p % 2 == 0 else 1), i))
        assert [got[p, boxes[i][4]] for i in order] == [(row[i], k) for k, i in enumerate(order)]
    assert {got[8, i][0] for i in range(3)} == {0}
    assert L.in_reading_order(df.limit(0), ["id"], F.lit(True)).count() == 0
