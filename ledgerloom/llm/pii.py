"""Personal data: high-recall candidates, boosted trees on format and context, calibrated thresholds.

Four kinds: email, ip, card, phone.  Strict patterns with checks give the base
spans, which always stay.  Wider generators propose further, possibly
overlapping candidates of each kind: written-out addresses, numbers without a
plus sign, numbers in other groupings, IPv6.  Boosted trees score a candidate
from its form (digit groups, separators, checks) and its context (keywords and
characters around it); Platt-calibrated probabilities above a kind's threshold
become spans, the most probable first where candidates overlap.

No table labels personal data, so the trees are trained on examples drawn by a
seeded generator: each kind in many forms, and look-alikes (dates, versions,
amounts, order numbers, times, hashes), with and without context words.  Half
of them fit the trees, a quarter the calibration, and a quarter chooses the
lowest threshold with a precision of at least PRECISION.

Texts are read whole, in one pass without a shuffle; only texts that hold what
every match needs (a digit, an at sign, the word "at" or three colons) become
Python strings.

Defined results: null and empty texts have no spans; offsets are code points;
base spans of different kinds may overlap, added ones overlap nothing; repeated
rows are searched row by row; clashing columns (`pii`) are replaced.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted, platt
from .kernel import Text, pieces, segment_sum

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
EXAMPLES = 6000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its start only: what fails there fails further in.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# The rest of an address after its local part, up to the second part of the host: every candidate has one.
_AT_HOST = r"(?:@|[\[({]\s?(?:at|AT|@)\s?[\])}]|\s(?:at|AT)\s)\s?[A-Za-z0-9-]{1,63}"
_DOT_PART = r"(?:\s?(?:\.|[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|\s(?:dot|DOT)\s)\s?[A-Za-z0-9-]{2,63})"
_EMAIL_GATE = re.compile(_AT_HOST + _DOT_PART)

#: Further candidates.
_WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?" + _AT_HOST + _DOT_PART + "{1,4}"),
    "ip": re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:\s?[\[(]\.[\])]\s?|\.)){3}[0-9]{1,3}(?![0-9A-Za-z.])|(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z.,+])[0-9](?:[ ./-]?[0-9]){12,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.,/$-])(?:\(?0?[0-9]{1,5}\)?[ .-]{1,2})(?:[0-9]{2,5}[ .-]){1,4}[0-9]{2,5}(?![0-9A-Za-z/-])"),
}
#: Words that tell what a number or an address is.
_WORDS = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "addr", "from", "login", "connect"),
    "card": ("card", "visa", "credit", "payment", "debit", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact", "whatsapp"),
    "other": ("date", "version", "order", "invoice", "isbn", "total", "id", "no", "page", "section", "build", "time", "amount", "ref", "sku", "release"),
}
#: Common endings of host names.
_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "de", "fr", "es", "uk", "eu", "example")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping matches of each kind that pass their checks, by kind and start."""
    out = []
    done, p = 0, t.find("@")
    while p >= 0:
        s = p
        while s > done and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, p + 1) if s < p else None
        if m:
            out.append(("email", s, m.end()))
        done = m.end() if m else p + 1
        p = t.find("@", done)
    for m in _IP.finditer(t):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(t):
        d = digits_of(m.group()) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(t: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in _WIDE.items():
        if kind == "email" and not _EMAIL_GATE.search(t):
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(t)]
    return found


def features(t: str, kind: str, s: int, e: int) -> list[float]:
    own, left, right = t[s:e], t[max(0, s - 40) : s].lower(), t[e : e + 20].lower()
    d = digits_of(own)
    groups = [len(g) for g in re.findall(r"[0-9]+", own)]
    words = re.findall(r"[a-z]+", left)[-4:]
    numbers = [int(g) for g in re.findall(r"[0-9]{1,9}", own)]
    hits = [float(any(any(w.startswith(k) for k in _WORDS[name]) for w in words)) for name in (*KINDS, "other")]
    form = [
        float(len(own)), float(len(d)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)), float(groups[-1] if groups else 0),
        float(luhn(d)) if len(d) > 1 else -1.0, float(own.count(" ")), float(own.count("-")), float(own.count(".")), float(own.count("/")), float(own.count(":")),
        float("(" in own), float("@" in own), float(bool(re.search(r"(?i)\b(at|dot)\b", own))), float(own[:1] == "0"), float(max(numbers, default=-1) > 255),
        float(any(1900 <= n <= 2099 for n in numbers)), float(len(set(d)) / max(1, len(d))), float(sum(c.isalpha() for c in own) / max(1, len(own))), float(len(re.split(r"[. ]", own)[-1])),
        float(own.count("[") + own.count("(") + own.count("{")), float(re.split(r"[^a-z]+", own.lower())[-1] in _ENDINGS),
    ]
    around = [float(left[-1:] in ("", " ", "\n")), float(left[-1:] in ("#", "$", "=", '"', "_")), float(right[:1] in ("", " ", "\n", ".", ",")), float(bool(re.match(r"\s*(usd|eur|%|km|kg|am|pm)", right)))]
    return [float(KINDS.index(kind)), *form, *hits, *around]


def examples(n: int = EXAMPLES, seed: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, kind) of seeded training examples: each candidate found in a made-up sentence."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("aeioubcdfghlmnprst"), rng.integers(2, 9)))

    def card() -> str:
        body = pick("4", "5", "37", "6011") + num(14)
        body = body[:15]
        d = next(c for c in "0123456789" if luhn(body + c))
        return body + d

    def group(s: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(s[at : at + k])
            at += k
        return sep.join(out)

    def email() -> str:
        at, dot = pick("@", " at ", "[at]", " (at) ", "(at)", " [at] "), pick(".", " dot ", "[dot]", " (dot) ")
        return f"{word()}{pick('', '.' + word(), num(2))}{at}{word()}{dot if at != '@' else '.'}{pick('com', 'org', 'net', 'de', 'example')}"

    def ip() -> str:
        if rng.random() < 0.4:
            return ":".join(format(x, "x") for x in rng.integers(256, 65536, 8))
        return pick(".", "[.]").join(map(str, rng.integers(1, 256, 4)))

    def phone() -> str:
        return pick(f"({num(3)}) {num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)}-{num(3)} {num(3)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}")

    def look_alike() -> str:
        r = rng.integers(1, 29)
        return pick(
            f"{rng.integers(1900, 2030)}-{rng.integers(10, 12)}-{r:02d} {rng.integers(10, 23)}", f"{r:02d}.{rng.integers(10, 12)}.{rng.integers(1900, 2030)} {num(2)}", f"v{num(1)}.{num(2)}.{num(1)}.{num(2)}",
            f"{num(1)}.{num(3)}.{num(3)}.{num(3)}.{num(1)}", f"{num(3)} {num(3)} {num(3)} {num(2)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(16)}", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"{num(4)} {num(4)} {num(4)} {num(4)}",
            f"{num(13)}", f"{num(14)}", f"{word()} at {word()} dot {word()}ing", f"{word()} at {word()}. {word()}", f"{num(4)} {num(4)} {num(2)}", f"{num(5)}-{num(4)}-{num(3)}-{num(5)}", f"{num(2)} {num(2)} {num(2)} {num(3)} {num(3)}", f"{rng.integers(256, 999)}.{num(3)}.{num(3)}.{num(3)}",
        )

    x, y, kinds = [], [], []
    while len(y) < n:
        kind = KINDS[rng.integers(4)]
        good = rng.random() < 0.45
        c = card()
        said = {"email": email, "ip": ip, "phone": phone, "card": lambda: pick(c, group(c, [4, 4, 4, 4], pick(" ", "-", ".", "/")), group(c, [6, 6, 4], " "))}[kind]() if good else look_alike()
        if good:
            hint = pick("", "", pick(*_WORDS[kind]) + pick(": ", " ", " is "))
        else:
            hint = pick("", "", pick(*_WORDS["other"]) + pick(": ", " ", " no. "), pick(*_WORDS[kind]) + " " + word() + " " + word() + " " + word() + " " + word() + " ")
        left, right = f"{word()} {word()} {hint}", pick("", ".", ",") + f" {word()} {word()}"
        if not good and rng.random() < 0.2:
            left += pick("#", "$", "=", '"')
        t = left + said + right
        for k, s, e in candidates(t):
            inside = s >= len(left) - 1 and e <= len(left) + len(said) + 1
            # Without any hint, bare digits are personal data only if they are well formed.
            true = good and inside and k == kind and e - s >= len(said) - 2 and (kind != "phone" or hint != "" or said[0] in "(0")
            x.append(features(t, k, s, e))
            y.append(float(true))
            kinds.append(KINDS.index(k))
    return np.array(x), np.array(y), np.array(kinds)


class Model:
    """Trees, calibration and the threshold of each kind."""

    def __init__(self, n: int = EXAMPLES, seed: int = 9, precision: float = PRECISION):
        x, y, kind = examples(n, seed)
        part = np.random.default_rng(seed + 1).permutation(len(y)) % 4
        self.trees = Boosted().fit(x[part < 2], y[part < 2])
        self.slope, self.offset = platt(self.trees.decision(x[part == 2]), y[part == 2])
        p = self.probability(x)
        self.threshold = {}
        for k, name in enumerate(KINDS):
            own = (part == 3) & (kind == k)
            order = np.argsort(-p[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, len(order) + 1)
            ok = np.flatnonzero(right >= precision)
            self.threshold[name] = float(max(0.5, p[own][order][ok[-1]])) if len(ok) else 1.1

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.decision(x) + self.offset, -35, 35)))


@functools.lru_cache(maxsize=4)
def trained(n: int = EXAMPLES, seed: int = 9) -> Model:
    return Model(n, seed)


class Taken:
    """Places that are taken, as disjoint intervals in order; asking takes the logarithm of their number."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.start: list[int] = []
        self.end: list[int] = []
        for s, e in sorted(spans):
            if self.end and s < self.end[-1]:
                self.end[-1] = max(self.end[-1], e)
            else:
                self.start.append(s)
                self.end.append(e)

    def overlaps(self, s: int, e: int) -> bool:
        i = bisect.bisect_right(self.end, s)
        return i < len(self.start) and self.start[i] < e

    def add(self, s: int, e: int) -> None:
        """s to e is free."""
        i = bisect.bisect_right(self.end, s)
        self.start.insert(i, s)
        self.end.insert(i, e)


def spans_of(texts: list[str], model: Model) -> list[list[tuple[str, int, int, float, bool]]]:
    """(kind, start, end, probability, base) of each text's spans, by kind and start."""
    bases = [base_spans(t) for t in texts]
    rows, owner = [], []
    for i, t in enumerate(texts):
        taken = Taken([(s, e) for _, s, e in bases[i]])
        for k, s, e in candidates(t):
            if not taken.overlaps(s, e):
                rows.append((k, s, e))
                owner.append(i)
    p = model.probability(np.array([features(texts[i], *r) for i, r in zip(owner, rows)])) if rows else np.zeros(0)
    added: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for i, r, q in zip(owner, rows, p.tolist()):
        if q >= model.threshold[r[0]]:
            added[i].append((*r, q))
    out = []
    for base, more in zip(bases, added):
        own = [(k, s, e, 1.0, True) for k, s, e in base]
        taken = Taken([(s, e) for _, s, e in base])
        for k, s, e, q in sorted(more, key=lambda m: (-m[3], m[1], m[2])):
            if not taken.overlaps(s, e):
                own.append((k, s, e, q, False))
                taken.add(s, e)
        out.append(sorted(own, key=lambda m: (KINDS.index(m[0]), m[1], m[2])))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
_SEEN = np.zeros(256)
_SEEN[[*range(48, 58), 0x40]] = 1
# What every candidate without a digit or an at sign holds: the word "at", or colons between hexadecimal groups.
_SIGN = re.compile(rb"(?<![0-9A-Za-z])(?:at|AT)(?![0-9A-Za-z])|(?:[A-Fa-f]{1,4}:){3}")


def _spans(part: pa.RecordBatch, model: Model) -> list[list[tuple]]:
    text = Text.of(part.column("text"))
    want = segment_sum(_SEEN[text.data], text.offsets) > 0
    for i in np.flatnonzero(~want).tolist():
        want[i] = _SIGN.search(text.data[text.offsets[i] : text.offsets[i + 1]].tobytes()) is not None
    at = np.flatnonzero(want)
    column = part.column("text")
    out: list[list[tuple]] = [[] for _ in range(part.num_rows)]
    for i, own in zip(at.tolist(), spans_of([column[i].as_py() for i in at.tolist()], model)):
        out[i] = own
    return out


def find(docs: DataFrame, keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """The columns `keep` of docs (all if not given) and `pii`, the spans of each text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("pii", SPAN)])
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = [[dict(zip(("kind", "start", "end", "score", "base"), s)) for s in own] for own in _spans(part, shared.value)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, _ARROW)], names=[*keep, "pii"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document."""
    base = F.filter("pii", lambda s: s["base"])
    of = lambda k: lambda s: s["kind"] == k
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def redacted(t: str | None, spans: list[tuple]) -> str | None:
    """The text with each group of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in sorted(((x[0], x[1], x[2]) for x in spans), key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [t[at:s], f"<{k.upper()}>"]
        at = e
    return "".join([*out, t[at:]]) if merged else t


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Pipeline form: personal data replaced by the name of its kind; n_chars follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                spans = _spans(part, shared.value)
                if any(spans):
                    texts = [redacted(t, s) if s else t for t, s in zip(part.column("text").to_pylist(), spans)]
                    part = part.set_column(at, "text", pa.array(texts, part.column("text").type))
                yield part

    out = docs.mapInArrow(run, schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(schema["n_chars"].dataType))
    return out.select(*columns)
