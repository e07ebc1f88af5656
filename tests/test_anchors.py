"""Entities at anchor words against a plain scanner over tokens."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.operators import anchors as A
from ledgerloom.plans.layout import ANNOUNCED

BOXES = set("─│┌┐└┘├┤┬┴┼═║╔╗╚╝")


def clean(w):
    return not BOXES & set(w)


def plain(text):
    words = (text or "").split()
    low, found = [w.lower() for w in words], []
    for a in A.ANCHORED:
        for i in range(len(words)):
            hit = next(((len(seq), c) for seq, c in a.anchors if tuple(low[i : i + len(seq)]) == seq), None)
            if not hit:
                continue
            for j in range(i + hit[0], min(len(words), i + hit[0] + a.reach)):
                w = words[j].rstrip(a.strip) if a.strip else words[j]
                if clean(words[j]) and re.search(a.fits, w):
                    grows = a.joins and j + 1 < len(words) and re.search(a.joins, words[j + 1])
                    found.append((a.label, j, f"{w}-{words[j + 1]}" if grows else w, hit[1]))
                    break
    for label, pattern, c in A.ALONE:
        found += [(label, i, w, c) for i, w in enumerate(words) if clean(w) and re.search(pattern, w)]
    line, starts = " ".join(low), [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
    for suffix in A.SUFFIXES:
        for m in re.finditer(rf"\b{suffix}\b", line):
            n = next((i for i, s in enumerate(starts) if s >= m.start()), None)
            if not n:
                continue
            tokens = [(i, words[i]) for i in range(max(0, n - 8), n) if clean(words[i])]
            value = " ".join(w for _, w in tokens)
            if tokens and value[-1] not in ".!?" and value[0].isupper():
                found.append(("SCHEME_NAME", tokens[0][0], value, A.SUFFIX_SCORE))
                break
    out = {}
    for label, at, value, c in found:
        best = out.get((at, label))
        if best is None or (-c, -len(value), value) < (-best[3], -len(best[2]), best[2]):
            out[at, label] = (label, at, value, c)
    return [out[k] for k in sorted(out)]


def test_entities(spark):
    rng = random.Random(6)
    vocabulary = " ".join(ANNOUNCED).split() + ["plot", "No", "#", "14", "A", "B/2", "x║y", "Street", "in", "Town", "city.", "mid-town", "Society", "reg.", "99", "Rs", "1,000;", "and", "Scheme", "Housing"]
    pages = [None, "", *ANNOUNCED, *(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(400))]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, text string")
    got = {r.i: [tuple(e) for e in r.e] for r in df.select("i", A.token_entities(F.col("text")).alias("e")).collect()}
    assert got == {i: plain(p) for i, p in enumerate(pages)}
    assert {e[0] for es in got.values() for e in es} == {"PLOT_NO", "REGISTRY_NO", "AMOUNT", "DATE", "CNIC", "SCHEME_NAME"}
