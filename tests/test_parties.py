"""Party roles against a plain form, line by line, and the name tests on single lines."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.operators import parties as P
from ledgerloom.plans.extraction import DEED_LINES

LINES = [
    *DEED_LINES, "Buyer - second party", "Seller and buyer appear here", "Rashid Mahmood Butt", "ok", "name with father", "Naeem Akhtar Chaudhry", "35202-1111111-1 Tahir Javed Malik", "page of nothing at all in it", "فروخت کنندہ", "کریم بخش",
    "بائع: Habib Bank Limited شناختی کارڈ", "خریدار: محمد اسلم گواہ", "گواہ نمبر 1: زاہد اقبال", "نام: فرید احمد", "Punjab Housing Society, of Lahore",
]
PLAIN_LINES = [x for x in LINES if not any(w in x for ws in P.PAGE_MARKS.values() for w in ws) and not any(w in x for ws, _ in P.PAGE_LABELS.values() for w in ws)]


class Facts:
    """What single lines are, by the library's own tests of one line."""

    def __init__(self, spark):
        inline = [m[1].strip() for x in LINES if (m := re.search(r"[:،]\s*(.+?)(?:\s*$|[,;])", x))]
        x = F.col("x")
        rows = spark.createDataFrame([(v,) for v in {*LINES, *inline}], "x string").select("x", P.clean_name(x).alias("clean"), P.section_of(x).alias("section"), P.is_sale_deed(x).alias("deed"), P.matching_form(x).alias("form"), P.below_label(x).alias("below"), *[P.after_label(x, P.matching_form(x), r).alias(r) for r in P.PAGE_LABELS]).collect()
        self.of = {r.x: r for r in rows}
        names = {v for r in rows for v in (r.x, r.clean, r.below, *(r[k] for k in P.PAGE_LABELS), r.x.split(",")[0].strip()) if v is not None}
        made = spark.createDataFrame([(v,) for v in names], "x string").select("x", P.is_name(x).alias("name"), P.is_person(x).alias("person"), (P.is_person(x) | P.is_organisation(x)).alias("party")).collect()
        self.is_ = {r.x: r for r in made}

    def named(self, line):
        return line is not None and self.is_[self.of[line].clean].name

    def fits(self, value, role):
        return value is not None and len(value) > 2 and (self.is_[value].person if role == "witness" else self.is_[value].party)


def page_ways(lines, f):
    """The two ways by pages: what they set, one after the other."""
    found, pages = {}, {}
    for p, n, x in lines:
        pages.setdefault(p, []).append((n, x))
    for p in sorted(pages):
        own = pages[p]
        for role, (labels, _) in P.PAGE_LABELS.items():
            for k, (_, x) in enumerate(own):
                if role in found or not any(w in f.of[x].form for w in labels):
                    continue
                options = [f.of[x][role], *(f.of[y].below for _, y in own[k + 1 : k + 7])]
                name = next((o for o in options if f.fits(o, role)), None)
                if name is not None:
                    found[role] = ("page_label", [" ".join(name.split())])
    numbers = [(k, p) for k, (p, _, x) in enumerate(lines) if re.search(P.CNIC, x)]
    if not numbers:
        return found
    has = lambda x, role: any(w in f.of[x].form for w in P.PAGE_MARKS[role])
    if "witness" not in found:
        marked = {p for p, own in pages.items() if any(has(x, "witness") for _, x in own)}
        names = [f.of[y].clean for k, p in numbers if p in marked and (y := best(lines, k, f)) and f.fits(f.of[y].clean, "witness")]
        if names:
            found["witness"] = ("page_mark", names)
    for role in ("buyer", "seller"):
        for p in sorted(pages):
            first = next((k for k, (_, x) in enumerate(pages[p]) if has(x, role)), None)
            if role in found or first is None:
                continue
            start = pages[p][first][0]
            for n, y in pages[p][first + 1 :]:
                shown = y.split(",")[0].strip()
                if n - start <= 10 and f.is_[y].party and 3 < len(shown) < 200:
                    found[role] = ("page_mark", [shown])
                    break
    return found


def best(lines, k, f):
    """The line that names the person whose number is in line k."""
    text = [x for *_, x in lines]
    raw = text[k] if f.named(text[k]) else text[k - 1] if k and f.named(text[k - 1]) else text[k + 1] if k + 1 < len(text) else None
    return raw if f.named(raw) else None


def labelled(lines, f):
    out, role, since, page = {}, None, None, None
    for k, (p, n, x) in enumerate(lines):
        if p != page:
            role, since, page = None, None, p
        if f.of[x].section:
            role, since = f.of[x].section, n
        form = f.of[x].form
        if (re.search("نام\\s*،|نام\\s+بمعہ?\\s+ولدیت", form) or (len(form) < 50 and re.search(r"name\s+with\s+father", form))) and role and n - since <= 30:
            m = re.search(r"[:،]\s*(.+?)(?:\s*$|[,;])", x)
            raw = (m[1].strip() or None) if m else None
            if raw is None and k + 1 < len(lines) and len(lines[k + 1][2].strip()) >= 3:
                raw = lines[k + 1][2]
            if f.named(raw):
                out.setdefault(role, []).append(f.of[raw].clean)
    return out


def anchors(lines, f):
    out, text = {}, [x for *_, x in lines]
    for k, x in enumerate(text):
        role = next((r for r, words in (("seller", "seller|vendor"), ("buyer", "buyer|purchaser|vendee"), ("witness", "witness|witnesses")) if re.search(rf"\b({words})\b", x.lower())), None)
        if not role:
            continue
        m = re.search(r"[:،]\s*(.+?)(?:\s*$|[,;])", x)
        raw = (m[1].strip() or None) if m else None
        if raw is None:
            for y in text[k + 1 : k + 4]:
                if re.search(r"\b(seller|buyer|witness|vendor|purchaser)\b", y.lower()):
                    break
                if f.named(y):
                    raw = y
                    break
        if f.named(raw):
            out.setdefault(role, []).append(f.of[raw].clean)
    return out


def plain(lines, f):
    """The ways one after another over one document's lines (page, number, text)."""
    if not any(f.of[x].deed for _, _, x in lines):
        return {}
    lines = [x for x in lines if x[2].strip()]
    found = page_ways(lines, f)
    if len(found) < 3:
        found |= {role: ("labelled", names) for role, names in labelled(lines, f).items()}
    urdu = [w for _, words, _ in P.MARKERS for w in words]
    people = [(k, lines[k][0], lines[k][1], f.of[y].clean) for k in range(len(lines)) if re.search(P.CNIC, lines[k][2]) and (y := best(lines, k, f))]
    section = {}
    for _, _, n, name in people:
        before = [(a, f.of[x].section) for _, a, x in lines if a < n and f.of[x].section and any(w in f.of[x].form for w in urdu)]
        if before and n - before[-1][0] < 25:
            section.setdefault(before[-1][1], []).append(name)
    one = [name for _, p, _, name in people if p == 1]
    page_order = {"seller": one[:1], "buyer": one[1:2]} if len(one) >= 2 else {}
    every = [name for *_, name in people]
    order = {"seller": every[:1], "buyer": every[1:2], "witness": every[2:]}
    for method, ways in (("section", section), ("page_order", page_order), ("order", order), ("anchor", anchors(lines, f))):
        found = {role: (method, names) for role, names in ways.items() if names} | found
    out = {}
    for role, (method, names) in found.items():
        unique = []
        for name in names:
            if name.lower() not in [x.lower() for x in unique]:
                unique.append(name)
        out[role] = ("; ".join(unique[:3] if role == "witness" else unique), method)
    return out


def test_roles_equal_the_plain_form(spark):
    rng = random.Random(8)
    pool = lambda d: LINES if d % 3 else [*PLAIN_LINES, "نام بمعہ ولدیت: کاشف زابد"]  # noqa: E731  every third has no Urdu labels
    docs = {d: [(1 + k // 9, k, rng.choice(pool(d))) for k in range(rng.choice([3, 8, 20, 60]))] for d in range(200)}
    lines = spark.createDataFrame([(d, *x) for d, own in docs.items() for x in own], "doc_id long, page int, line_no int, line string")
    f = Facts(spark)
    got: dict = {}
    for r in P.party_roles(lines).collect():
        got.setdefault(r.doc_id, {})[r.role] = (r.names, r.method)
    want = {d: w for d, own in docs.items() if (w := plain(own, f))}
    assert got == want
    assert {m for w in want.values() for _, m in w.values()} == set(P.METHODS)


def test_labelled_fields_overwrite_page_ways_unless_these_have_all(spark):
    head = ["Sale Deed", "بائع: محمد اسلم", "نام بمعہ ولدیت: حسن عسکری"]
    rest = ["خریدار: فرید احمد", "گواہ نمبر 1: زاہد اقبال"]
    df = spark.createDataFrame([(d, 1, k, x) for d, own in enumerate((head, head + rest)) for k, x in enumerate(own)], "doc_id long, page int, line_no int, line string")
    got = {(r.doc_id, r.role): (r.names, r.method) for r in P.party_roles(df).collect()}
    assert got[0, "seller"] == ("حسن عسکری", "labelled") and got[1, "seller"] == ("محمد اسلم", "page_label")
    assert got[1, "buyer"] == ("فرید احمد", "page_label") and got[1, "witness"][1] == "page_label"


def test_organisations(spark):
    want = {"Habib Bank Limited": (True, False), "Ali Raza Khan": (False, True), "in witness whereof the bank": (False, False), "محمد اسلم": (False, True), "12 34 bank 5678 90": (False, False), "": (False, False)}
    got = spark.createDataFrame([(x,) for x in [*want, None]], "x string").select("x", P.is_organisation(F.col("x")).alias("o"), P.is_person(F.col("x")).alias("p")).collect()
    assert {r.x: (r.o, r.p) for r in got} == want | {None: (False, False)}


def test_names(spark):
    good = ["Ali Raza Khan", "کاشف زابد", "Muhammad Aslam"]
    bad = ["executed by", "Ali", "a b c", "12345 67", "north of the property", "نام", "", None, "##!! xx", "ab cd ef gh"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string")
    got = {r.x: r.n for r in df.select("x", P.is_name(F.col("x")).alias("n")).collect()}
    assert [x for x in good if not got[x]] == [] and [x for x in bad if got[x]] == []
    clean = {"Vendor: Ali Khan s/o Bashir": "Ali Khan", "Name - Sara 35202-1234567-1": "Sara", "بائع: کاشف زابد ولد کریم": "کاشف زابد"}
    got = spark.createDataFrame([(x,) for x in clean], "x string").select("x", P.clean_name(F.col("x")).alias("c")).collect()
    assert {r.x: r.c for r in got} == clean
