"""Names of parties in sale deeds: text tests as expressions, and role extraction as window plans over lines.

Lines are rows (doc_id, page, line_no, line), numbered through a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bound
from ..functions.text import ARABIC, squeeze

#: Words that make a document a sale deed.
DEED_WORDS = (
    "sale deed", "deed of sale", "sale agreement", "agreement of sale", "vendor", "vendee", "purchaser", "seller", "buyer", "consideration", "sold to", "purchased from", "transfer deed",
    "بیع نامہ", "فروخت نامہ", "فروخت کنندہ", "خریدار", "گواہ", "بیع", "فروخت", "خریداری", "فروخت کنندگان", "خریداران",
)
#: Section headings; English ones count only in lines of under 50 characters.
MARKERS = [
    ("seller", ("بائع", "فروخت کنندہ", "بیچنے والا", "مالک", "نام مالک"), ("seller", "vendor", "first party")),
    ("buyer", ("مشتری", "خریدار", "خرید کنندہ", "نام مشتری"), ("buyer", "purchaser", "vendee", "second party")),
    ("witness", ("گواہان", "گواہ", "گواہ نمبر", "نام گواہ", "شاہد"), ("witness", "witnesses")),
]
#: Words no name has.
NO_NAME = (
    "executed by", "in witness", "witness whereof", "vendor", "vendee", "party", "schedule of property", "description", "north", "south", "east", "west", "signed", "sealed", "delivered", "hereinafter", "called",
    "deed", "sale", "signature", "witness", "attesting", "property", "schedule", "hereby", "نام", "ولدیت", "شناختی کارڈ نمبر", "شناختی", "کارڈ", "نمبر", "ساکن", "رہائشی", "ضلع", "تحصیل", "پتہ", "مکان", "پلاٹ",
)
#: Labels before a name, and words that end it: the first of a list that occurs counts, wherever it stands.
LABELS = ("فریق اول", "فریق دوم", "بائع", "مشتری", "خریدار", "گواہ", "گواہان", "فروخت کنندہ", "فروشندہ", "شاہد", "شاہدین", "نام", "ولدیت", "seller", "buyer", "vendor", "purchaser", "vendee", "witness", "witnesses", "first party", "second party", "attesting witness", "executed by", "name")
URDU_STOPS = (
    "ولد", "ولدہ", "ساکن", "رہائشی", "تحصیل", "ضلع", "شناختی", "کارڈ", "قوم", "پتہ", "نمبر", "مکان", "پلاٹ", "کا", "کی", "کے", "اور", "یا", "نام", "ولدیت",
)
ENGLISH_STOPS = (
    "s/o", "d/o", "w/o", "c/o", "son of", "daughter of", "wife of", "resident", "cnic", "nic", "address", "district", "tehsil", "executed by", "witness", "vendor", "vendee", "signature", "signed", "sealed",
)
#: A page's labels of a role, and what ends a name after one; the first label of a list that a line has counts.
PAGE_LABELS = {
    "seller": (("بائع", "فروشندہ", "نام بائع", "نامِ بائع", "نام مالک", "مالک", "فروخت کنندہ"), "CNIC|شناختی|کارڈ|خریدار|مشتری|گواہ"),
    "buyer": (("مشتری", "خریدار", "نام مشتری", "نامِ مشتری", "نام خریدار"), "CNIC|شناختی|کارڈ|گواہ|فروخت"),
    "witness": (("گواہ", "گواہان", "نام گواہ", "گواہ نمبر", "شاہد"), "CNIC|شناختی|کارڈ|Property"),
}
#: Words that mark a page as one of a role.
PAGE_MARKS = {"seller": ("فروشندہ", "بائع", "فروخت کنندہ", "مالک"), "buyer": ("مشتری", "خریدار", "خرید کنندہ"), "witness": ("گواہان", "گواہ", "گواہ نمبر", "شاہد")}
#: Words of organisations, and phrases that no organisation's name has.
ORGANISATIONS = ("bank", "ltd", "limited", "pvt", "private", "company", "co", "corp", "corporation", "society", "association", "trust", "foundation", "group", "holdings", "بینک", "لمیٹڈ", "پرائیویٹ", "کمپنی", "کارپوریشن", "سوسائٹی", "ٹرسٹ")
NARRATIVE = ("executed by", "in witness", "witness whereof", "witnesses named", "appears", "vide", "in this regard", "competent", "lawful")
LEAST_SCORE = 0.65
SECTION_LINES, ANCHOR_LINES, LOOK_AHEAD, PAGE_AHEAD, MARK_AHEAD, WITNESSES = 30, 25, 3, 6, 10, 3
METHODS = ("labelled", "page_label", "page_mark", "section", "page_order", "order", "anchor")
CNIC = "[0-9]{5}[- ]?[0-9]{7}[- ]?[0-9]"
_SCRIPT = "\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF"


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def _contained_in(text: Column):
    return lambda word: F.contains(text, word)


def is_sale_deed(text: Column) -> Column:
    return F.coalesce(_has(F.lower(squeeze(text)), DEED_WORDS), F.lit(False))


def matching_form(line: Column) -> Column:
    """Lower case, one blank between words, no signs but those of Arabic script."""
    return squeeze(F.lower(F.regexp_replace(line, f"[^\\p{{L}}\\p{{N}}_\\s{ARABIC}،؛]", "")))


def section_of(line: Column) -> Column:
    """The role whose heading a line is, or null; sellers before buyers before witnesses."""
    form, out = matching_form(line), F
    for role, urdu, english in MARKERS:
        out = out.when(_has(form, urdu) | ((F.length(form) < 50) & _has(form, english)), role)
    return out.otherwise(None)


def clean_line(line: Column) -> Column:
    return squeeze(F.regexp_replace(squeeze(line), "[.,;:!?]{2,}", " "))


def clean_name(raw: Column) -> Column:
    """Without numbers, leading labels and whatever follows a stop word."""
    s = F.regexp_replace(squeeze(raw), f"{CNIC}|[0-9]{{6,}}", "")
    labels = "|".join(sorted(LABELS, key=len, reverse=True))
    s = F.regexp_replace(s, f"(?i)^(?:(?:{labels})\\s*[:،,\\-]?\\s*)+", "")

    def cut(stops: tuple[str, ...], form: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def before(x: Column) -> Column:
            stop = F.try_element_at(F.filter(F.array(*[F.lit(w) for w in stops]), _contained_in(form(x))), F.lit(1))
            return bound(stop, lambda w: F.when(w.isNull(), x).otherwise(F.trim(F.substring(x, F.lit(1), F.instr(form(x), w) - 1))))

        return before

    s = bound(bound(s, cut(URDU_STOPS, lambda x: x)), cut(ENGLISH_STOPS, F.lower))
    return squeeze(F.regexp_replace(s, "[.,;:!?]{2,}", " "))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def name_score(line: Column) -> Column:
    """How likely a line is a person's name, from 0 to 1."""
    return bound(clean_line(line), lambda s: _score(line, s))


def _score(line: Column, s: Column) -> Column:
    """name_score of a line whose clean form is s; what is used often is bound, as Catalyst would copy it into each use."""
    size = F.greatest(F.length(s), F.lit(1))
    words = F.filter(F.split(s, " "), lambda w: w != "")
    parts = F.struct(
        F.lower(s).alias("low"), (_count(s, f"a-zA-Z{ARABIC}") / size).alias("letters"), (_count(s, _SCRIPT) / size).alias("arabic"), (F.length(F.regexp_replace(s, f"[\\p{{L}}\\p{{N}}_\\s{ARABIC}]", "")) / size).alias("signs"),
        words.alias("words"), F.filter(words, lambda w: w.rlike(f"[{ARABIC}]")).alias("script"), F.filter(words, lambda w: w.rlike("^[a-zA-Z]{2,}$")).alias("latin"), s.rlike("ولد|بن|بنت").alias("kin"),
    )
    score = bound(parts, lambda p: _score_of_parts(s, size, p))
    return F.when(line.isNull() | (F.length(F.trim(line)) < 2), 0.0).otherwise(score)


def _score_of_parts(s: Column, size: Column, p: Column) -> Column:
    low, letters, arabic, signs, words, script, latin, kin = (p[k] for k in ("low", "letters", "arabic", "signs", "words", "script", "latin", "kin"))
    n, short = F.size(words), F.size(F.filter(words, lambda w: F.length(w) <= 2))
    long_latin = F.exists(latin, lambda w: F.length(w) >= 4)
    bad = (
        _has(low, NO_NAME) | (_count(s, f"\\p{{L}}\\p{{N}}_{ARABIC}") < 3) | (letters < 0.3) | ((letters < 0.55) & (arabic < 0.20)) | (signs > 0.3)
        | low.rlike("\\b([a-z]{1,2})\\s+\\1\\s+[a-z]{1,2}\\b") | ((n >= 3) & F.forall(words, lambda w: F.length(w) <= 3)) | ((n > 2) & (short > n * 0.5)) | low.rlike("\\b[a-z]{1,3}(\\s+[a-z]{1,3}){3}\\b")
        | ((arabic > 0.3) & ~kin & (F.size(script) < 2) & ~((F.length(F.try_element_at(script, F.lit(1))) >= 4) & (letters > 0.7)))
        | ((F.size(latin) >= 2) & ~long_latin)
    )
    urdu = F.when(arabic > 0.3, 0.3 + F.when(F.length(F.regexp_extract(s, "(.+?)\\s*(?:ولد|بن|بنت)", 1)) >= 3, 0.1).otherwise(0.0) + F.when(F.size(script) >= 2, 0.1).when(~kin, 0.05).otherwise(0.0)).otherwise(0.0)
    english = F.when((F.size(latin) >= 2) & long_latin, 0.2 + F.when(signs < 0.15, 0.1).otherwise(0.0)).otherwise(0.0)
    length = F.when(F.length(s) < 4, -0.2).when(F.length(s) <= 60, 0.1).otherwise(0.0)
    digits = F.when(_count(s, "0-9") / size > 0.1, -0.3).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + urdu + english + length + digits)), 6)
    return F.when(F.coalesce(bad, F.lit(True)), 0.0).otherwise(score)


def is_name(line: Column) -> Column:
    """Two words of Arabic script, or a score of at least 0.65."""
    blocked = _has(F.lower(line), ("executed by", "in witness", "witness whereof", "vendor", "vendee", "signature", "witness", "signed", "sealed", "delivered"))

    def named(s: Column) -> Column:
        script = F.filter(F.split(s, " "), lambda w: w.rlike(f"[{ARABIC}]"))
        two = bound(script, lambda x: (F.size(x) == 2) & F.forall(x, lambda w: F.length(w) >= 2)) & (_count(s, f"a-zA-Z{ARABIC}") / F.greatest(F.length(s), F.lit(1)) >= 0.5)
        return two | (_score(line, s) >= LEAST_SCORE)

    return F.coalesce((F.trim(line) != "") & ~blocked & bound(clean_line(line), named), F.lit(False))


def is_organisation(text: Column) -> Column:
    """Named as an organisation, and not a sentence about one."""
    s = squeeze(text)
    solid = F.regexp_replace(s, "\\s", "")
    letters = F.length(F.regexp_replace(solid, "\\P{L}", "")) / F.greatest(F.length(solid), F.lit(1))
    return F.coalesce(_has(F.lower(s), ORGANISATIONS) & ~_has(F.lower(s), NARRATIVE) & ~s.rlike("[!?]|(\\..*){6}") & (letters >= 0.5) & F.length(s).between(3, 120), F.lit(False))


def is_person(text: Column) -> Column:
    """A name, and not an organisation's."""
    return is_name(text) & (F.length(squeeze(text)) >= 3) & ~F.coalesce(_has(F.lower(text), (*ORGANISATIONS, "branch", "act", "برانچ")), F.lit(False))


def after_label(line: Column, form: Column, role: str) -> Column:
    """The name that follows the role's label and a colon in a line, or null."""
    labels, stops = PAGE_LABELS[role]
    label = F.try_element_at(F.filter(F.array(*[F.lit(w) for w in labels]), _contained_in(form)), F.lit(1))
    rest = F.substring(line, F.instr(form, label) + F.length(label), F.length(line))
    name = F.regexp_extract(F.trim(rest), f"(?i)[:،]\\s*(.+?)(?:$|{stops})", 1)
    name = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "^نام(\\s*بمعہ\\s+ولدیت)?\\s*[:،]\\s*", ""), f"(?i)\\s*(?:{stops.partition('|')[2]}).*$", ""))
    return F.when(label.isNotNull() & (F.length(name) > 2), name)


def below_label(line: Column) -> Column:
    """What a line under a label offers as a name: what follows its own word for name, or the line."""
    own = F.trim(F.regexp_extract(line, "(?i)نام\\s*(?:بمعہ\\s+ولدیت)?\\s*[:،]\\s*(.+?)(?:$|CNIC|شناختی|کارڈ)", 1))
    return F.when(own != "", own).otherwise(F.trim(line))


def vendor_and_vendee(text: Column) -> Column:
    """(seller, buyer) of "between .. (hereinafter called .. vendor) and .. (hereinafter called .. vendee)", where they can be names."""
    called = lambda who: f"\\([^)]*hereinafter[^)]*called[^)]*{who}[^)]*\\)"
    pattern = f"(?is)between\\s+(.+?)\\s+{called('vendor')}\\s+and\\s+(.+?)\\s+{called('vendee')}"

    def checked(name: Column) -> Column:
        return F.when((F.length(name) >= 3) & (F.length(name) <= 80) & ~name.rlike("[.,;:!?]") & ~_has(F.lower(name), NO_NAME), name)

    part = lambda i: bound(clean_name(F.regexp_extract(text, pattern, i)), checked)
    return F.struct(part(1).alias("seller"), part(2).alias("buyer"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once for each row, however often they are used."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", made.alias("_m")).select(*df.columns, *[F.col(f"_m.{k}").alias(k) for k in columns])


def _first(*found: Column) -> Column:
    return F.coalesce(*found) if found else F.lit(None)


def party_roles(lines: DataFrame) -> DataFrame:
    """(doc_id, role, names, method) of sale deeds.

    Seven ways of finding names:

    * page_label: a page's line with the role's Urdu label, by the name after
      it or the first party in the six lines below; the first such page counts.
    * page_mark: pages with an Urdu mark of the role.  Sellers and buyers are
      the first party in the ten lines after the mark, witnesses the persons
      with an identity number on those pages; only in documents with numbers.
    * labelled: labelled fields within a section.
    * section: persons with a number under the nearest Urdu heading before
      them, fewer than 25 lines away.
    * page_order: first and second person with a number on page 1, if it has two.
    * order: first, second and further persons with a number in the document.
    * anchor: names at English anchors.

    A role takes the first way that has any, in the order of METHODS: labelled
    fields overwrite both page ways, but where these have found all three roles
    they aren't looked at.  Names are unique without regard to case, in order
    of their lines, at most three witnesses, joined by "; ".
    """
    deeds = lines.groupBy("doc_id").agg(F.max(is_sale_deed(F.col("line"))).alias("deed")).where("deed").select("doc_id")
    text, form = F.col("line"), F.col("form")
    roles = list(PAGE_LABELS)
    inline = F.nullif(F.trim(F.regexp_extract(text, "[:،]\\s*(.+?)(?:\\s*$|[,;])", 1)), F.lit(""))
    x = lines.join(deeds, "doc_id", "left_semi").where(F.trim("line") != "").select("doc_id", "page", "line_no", "line", section_of(text).alias("role"), matching_form(text).alias("form"), inline.alias("inline"))
    # What a line and its parts are as names is found once, in generators, so that the tests aren't copied into each use.
    x = _once(x, own=clean_name(text), part=clean_name(F.col("inline")), below=below_label(text), shown=F.trim(F.split_part(text, F.lit(","), F.lit(1))), **{f"after_{r}": after_label(text, form, r) for r in roles})
    x = _once(x, own_ok=is_name(F.col("own")), part_ok=is_name(F.col("part")), below_person=is_person(F.col("below")), line_party=F.length("shown").between(4, 199) & (is_person(text) | is_organisation(text)))
    x = x.withColumn("below_party", F.col("below_person") | is_organisation(F.col("below")))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    me = F.struct("page", "line_no", "line", "own", "own_ok", "below", "below_person", "below_party", "shown", "line_party")
    marked = {f"has_{r}": F.lit(False) for r in roles}
    for r in roles:
        for word in PAGE_MARKS[r]:
            marked[f"has_{r}"] = marked[f"has_{r}"] | form.contains(word)
    x = x.withColumns(marked)
    x = x.withColumns(
        {f"next{k}": F.lead(me, k).over(w) for k in range(1, MARK_AHEAD + 1)}
        | {"before": F.lag(me).over(w), "section": F.last("role", True).over(page), "since": F.last(F.when(F.col("role").isNotNull(), F.col("line_no")), True).over(page)}
        | {f"nth_{r}": F.count(F.when(F.col(f"has_{r}"), 1)).over(page) for r in roles}
        | {"witness_page": F.max("has_witness").over(Window.partitionBy("doc_id", "page")), "numbers": F.max(text.rlike(CNIC)).over(Window.partitionBy("doc_id"))}
    )
    part = F.when(F.col("inline").isNotNull(), F.struct(F.col("part").alias("own"), F.col("part_ok").alias("own_ok")))
    named = lambda c: F.struct(c["own"].alias("own"), c["own_ok"].alias("own_ok"))
    sure = lambda name, ok: F.when(ok, F.struct(squeeze(name).alias("own"), F.lit(True).alias("own_ok")))

    # Labels and marks of pages: a line's own name, or the first fitting line near it on the page.
    near = [F.col(f"next{k}") for k in range(1, MARK_AHEAD + 1)]
    label_ways, mark_ways = {}, {}
    for r in roles:
        kind = "below_person" if r == "witness" else "below_party"
        after = F.col(f"after_{r}")
        ok = is_person(after) if r == "witness" else is_person(after) | is_organisation(after)
        has = F.lit(False)
        for word in PAGE_LABELS[r][0]:
            has = has | form.contains(word)
        label_ways[r] = F.when(has, _first(sure(after, ok), *[sure(n["below"], (n["page"] == F.col("page")) & n[kind] & (F.length(n["below"]) > 2)) for n in near[:PAGE_AHEAD]]))
        if r != "witness":
            mark_ways[r] = F.when(F.col(f"has_{r}") & (F.col(f"nth_{r}") == 1) & F.col("numbers"), _first(*[sure(n["shown"], (n["page"] == F.col("page")) & (n["line_no"] - F.col("line_no") <= MARK_AHEAD) & n["line_party"]) for n in near]))

    label = form.rlike("نام\\s*،|نام\\s+بمعہ?\\s+ولدیت") | ((F.length("form") < 50) & form.rlike("name\\s+with\\s+father"))
    labelled = F.when(label & (F.col("line_no") - F.col("since") <= SECTION_LINES), F.coalesce(part, F.when(F.length(F.trim("next1.line")) >= 3, named(F.col("next1")))))
    best = F.when(F.col("own_ok"), named(me)).when(F.col("before.own_ok"), named(F.col("before"))).otherwise(named(F.col("next1")))
    person = F.when(text.rlike(CNIC) & F.coalesce(best["own_ok"], F.lit(False)), best)
    anchor = F.when(F.lower(text).rlike("\\b(seller|vendor)\\b"), "seller").when(F.lower(text).rlike("\\b(buyer|purchaser|vendee)\\b"), "buyer").when(F.lower(text).rlike("\\bwitness(es)?\\b"), "witness")
    heading = "\\b(seller|buyer|witness|vendor|purchaser)\\b"
    ahead, open_ = [], F.lit(True)
    for n in near[:LOOK_AHEAD]:
        open_ = open_ & ~F.coalesce(F.lower(n["line"]).rlike(heading), F.lit(False))
        ahead.append(F.when(open_ & n["own_ok"], named(n)))
    x = _once(x, labelled=labelled, person=person, anchor=anchor, anchored=F.coalesce(part, *ahead), **{f"label_{r}": c for r, c in label_ways.items()}, **{f"mark_{r}": c for r, c in mark_ways.items()})
    urdu = F.lit(False)
    for _, words, _ in MARKERS:
        urdu = urdu | _has(form, words)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({
        "mark": F.last(F.when(F.col("role").isNotNull() & urdu, F.struct("line_no", "role")), True).over(earlier),
        "nth": F.count("person").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "nth_page": F.count("person").over(page.rowsBetween(Window.unboundedPreceding, 0)),
        "on_page": F.count("person").over(Window.partitionBy("doc_id", "page")),
    })
    under = F.when(F.col("line_no") - F.col("mark.line_no") < ANCHOR_LINES, F.col("mark.role"))
    two = F.when((F.col("page") == 1) & (F.col("on_page") >= 2), F.when(F.col("nth_page") == 1, "seller").when(F.col("nth_page") == 2, "buyer"))
    order = F.when(F.col("nth") == 1, "seller").when(F.col("nth") == 2, "buyer").otherwise("witness")
    person_here = F.when(F.col("witness_page") & is_person(F.col("person.own")), F.col("person"))
    ways = [
        *(("page_label", F.lit(r), F.col(f"label_{r}")) for r in roles),
        *(("page_mark", F.lit(r), F.col(f"mark_{r}")) for r in mark_ways), ("page_mark", F.lit("witness"), person_here),
        ("labelled", F.col("section"), F.col("labelled")), ("section", under, F.col("person")), ("page_order", two, F.col("person")), ("order", order, F.col("person")), ("anchor", F.col("anchor"), F.col("anchored")),
    ]
    found = F.array(*[F.struct(F.lit(METHODS.index(m)).alias("tier"), F.lit(m).alias("method"), role.alias("role"), name["own"].alias("name"), name["own_ok"].alias("ok")) for m, role, name in ways])
    every = x.select("doc_id", "line_no", F.explode(F.filter(found, lambda f: f["ok"] & f["role"].isNotNull())).alias("f")).select("doc_id", "line_no", "f.*")
    unique = every.groupBy("doc_id", "role", "tier", "method", F.lower("name").alias("_key")).agg(F.min(F.struct("line_no", "name")).alias("n"))
    tiers = unique.groupBy("doc_id", "role", "tier", "method").agg(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["name"]).alias("names"))
    # One of a page way is enough; where these have all roles, labelled fields are left out.
    paged = F.size(F.collect_set(F.when(F.col("method").isin("page_label", "page_mark"), F.col("role"))).over(Window.partitionBy("doc_id"))) == len(roles)
    tiers = tiers.withColumn("paged", paged).where("NOT (paged AND method = 'labelled')")
    out = tiers.groupBy("doc_id", "role").agg(F.min(F.struct("tier", "method", "names")).alias("best")).select("doc_id", "role", "best.method", "best.names")
    one = (F.col("method") == "page_label") | ((F.col("method") == "page_mark") & (F.col("role") != "witness"))
    return out.select("doc_id", "role", F.array_join(F.when(one, F.slice("names", 1, 1)).when(F.col("role") == "witness", F.slice("names", 1, WITNESSES)).otherwise(F.col("names")), "; ").alias("names"), "method")
