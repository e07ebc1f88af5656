"""The rule engine: a pack of rules over all cases at once.

A rule names an evaluator; evaluators are compiled into conditions on single
rows, each a bit, so a whole pack is one scan of each fact table, one aggregate
by case and one read-out.  Rules are few and fixed for a run, so their terms
are constants of the plan instead of being joined.

Case facts are DataFrames: facts(case_id, key, value), documents(case_id,
doc_type), pages(case_id, page, text), checks(case_id, kind, status).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keywords import masks


@dataclass(frozen=True)
class Rule:
    id: str
    evaluator: str
    severity: str = "Medium"
    title: str = ""
    required: tuple[str, ...] = ()
    pattern: str = ""
    keywords: tuple[str, ...] = ()
    indicators: tuple[str, ...] = ()
    kind: str = ""
    keys: tuple[str, ...] = ()
    regimes: tuple[str, ...] = ()
    conditional: str = ""
    cp: str = ""


@dataclass
class Facts:
    cases: DataFrame  # case_id, regime
    facts: DataFrame
    documents: DataFrame
    pages: DataFrame
    checks: DataFrame


_SEVERITIES = ("High", "Medium", "Low")


def _rule(r: dict) -> Rule:
    """A pack's entry: `inputs`, `logic` and `outputs` hold what its evaluator reads."""
    inputs, logic, outputs = (r.get(k) or {} for k in ("inputs", "logic", "outputs"))
    many = lambda x: tuple(str(v) for v in x or ())
    evaluator = r.get("evaluator", "missing_evidence")
    return Rule(
        id=r["id"],
        evaluator=evaluator if evaluator in EVALUATORS else "missing_evidence",
        severity=r["severity"],
        title=outputs.get("title", ""),
        required=many(logic.get("required_doc_types")),
        pattern=logic.get("field_pattern", ""),
        keywords=many(logic.get("keywords_any") or inputs.get("keywords")),
        indicators=many(logic.get("constructed_indicators")),
        kind=inputs.get("verification_type", ""),
        keys=many(inputs.get("dossier_keys")),
        regimes=tuple(x.strip() for x in many(logic.get("regimes")) if x.strip()),
        conditional=str(logic.get("conditional") or ""),
        cp=outputs.get("cp", ""),
    )


def validated(raw: list) -> tuple[list[Rule], list[str]]:
    """Rules that can run, and an error for each entry that can't; unknown evaluators fall back to missing_evidence."""
    good, errors = [], []
    for r in raw if isinstance(raw, list) else []:
        if not isinstance(r, dict):
            errors.append("rule is no mapping")
        elif not isinstance(r.get("id"), str) or not r["id"]:
            errors.append("rule missing id")
        elif not isinstance(r.get("module"), str) or not r["module"]:
            errors.append(f"{r['id']}: missing module")
        elif r.get("severity") not in _SEVERITIES:
            errors.append(f"{r['id']}: invalid severity")
        else:
            good.append(_rule(r))
    return good, errors


def keyword_references(rule: Rule, f: Facts) -> DataFrame:
    """(case_id, rule_id, doc_id, page, note): one reference for each page with a keyword, naming the first in the rule's order."""
    p = f.pages if "doc_id" in f.pages.columns else f.pages.withColumn("doc_id", F.lit(None).cast("long"))
    low = F.lower("text")
    hits = F.filter(F.array(*[F.lit(k) for k in rule.keywords]), lambda k: low.contains(F.lower(k)))
    found = p.select("case_id", "doc_id", "page", F.try_element_at(hits, F.lit(1)).alias("word")).where("word IS NOT NULL")
    return found.join(f.cases.select("case_id"), "case_id", "left_semi").select("case_id", F.lit(rule.id).alias("rule_id"), "doc_id", "page", F.concat(F.lit("Contains keyword: "), "word").alias("note"))


EVALUATORS = ("missing_evidence", "mismatch", "keyword_risk", "constructed_gate", "timeline_gap", "verification_check")
WIDTH = 62  # conditions in a number
#: From so many keywords on, pages are walked through one automaton instead of searched for each.
MANY_WORDS = 24


class _Conditions:
    """What rules ask of single rows, each a bit of the numbers _b0, _b1, ...; alike ones share a bit."""

    def __init__(self, rules: list[Rule]):
        self.at: dict[tuple, int] = {}
        self.firsts: list[tuple[str, ...]] = []  # keyword lists whose first page is asked for
        self.patterns: list[str] = []  # key patterns whose distinct values are counted
        for r in rules:
            if r.evaluator in ("missing_evidence", "constructed_gate"):
                self.ask("type", *(q.lower() for q in r.required))
            if r.evaluator == "constructed_gate":
                self.ask("built", "")
                self.ask("word", *(k.lower() for k in r.indicators))
            if r.evaluator in ("keyword_risk", "verification_check"):
                self.ask("word", *(k.lower() for k in r.keywords))
            if r.evaluator == "verification_check":
                self.ask("key", *r.keys)
                self.ask("check", (r.kind, "Verified"), (r.kind, "Failed"))
                if r.keywords and r.keywords not in self.firsts:
                    self.firsts.append(r.keywords)
            if r.evaluator == "mismatch" and r.pattern not in self.patterns:
                self.patterns.append(r.pattern)

    def ask(self, kind: str, *terms) -> None:
        for t in terms:
            self.at.setdefault((kind, t), len(self.at))

    @property
    def names(self) -> list[str]:
        return [f"_b{i}" for i in range(-(-len(self.at) // WIDTH))]

    def of(self, *kinds: str) -> list[tuple]:
        return [c for c in self.at if c[0] in kinds]

    def numbers(self, holds: dict[tuple, str]) -> list[Column]:
        """_b0.. of a row, from a test in SQL for each condition that its table can meet."""
        terms: list[list[str]] = [["0L"] for _ in self.names]
        for c, test in holds.items():
            at = self.at[c]
            terms[at // WIDTH].append(f"if({test}, {1 << at % WIDTH}L, 0L)")
        return [F.expr(" | ".join(t)).alias(n) for t, n in zip(terms, self.names)]

    def any(self, kind: str, *terms) -> str:
        """Whether a row or case has one of the terms, in SQL."""
        wanted: dict[int, int] = {}
        for t in terms:
            at = self.at[kind, t]
            wanted[at // WIDTH] = wanted.get(at // WIDTH, 0) | 1 << at % WIDTH
        return "(" + " OR ".join(f"(_b{i} & {mask}L) <> 0" for i, mask in wanted.items()) + ")" if wanted else "FALSE"

    def words(self, keywords: tuple[str, ...]) -> str:
        return self.any("word", *(k.lower() for k in keywords))


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _signals(c: _Conditions, f: Facts) -> list[DataFrame]:
    """What each table says of cases, as numbers of bits; every table is read once."""
    out = []
    if types := c.of("type"):
        low = f.documents.select("case_id", F.lower("doc_type").alias("_t"))
        out.append(low.select("case_id", *c.numbers({t: f"contains(_t, {quoted(t[1])}) OR contains({quoted(t[1])}, _t)" for t in types})))
    if checks := c.of("check"):
        out.append(f.checks.select("case_id", *c.numbers({t: f"kind = {quoted(t[1][0])} AND status = {quoted(t[1][1])}" for t in checks})))
    if words := c.of("word"):
        pages = f.pages.select("case_id", "page", "text")
        if len(words) >= MANY_WORDS:
            marked = masks(pages, {t[1]: c.at[t] for t in words}, len(c.names), width=WIDTH)
        else:
            marked = pages.select("case_id", "page", F.lower("text").alias("_t")).select("case_id", "page", *c.numbers({t: f"contains(_t, {quoted(t[1])})" for t in words}))
        out.append(marked.select("case_id", *c.names, *[F.expr(f"if({c.words(k)}, page, NULL)").alias(f"_first{i}") for i, k in enumerate(c.firsts)]))
    if c.of("key", "built") or c.patterns:
        holds = {t: f"contains(key, {quoted(t[1])}) AND trim(value) <> ''" for t in c.of("key")} | {t: "key = 'property.constructed' AND lower(value) IN ('true', 'yes', '1')" for t in c.of("built")}
        if not c.patterns:
            out.append(f.facts.select("case_id", *c.numbers(holds)))
        else:
            # A row for the bits, and one for each pattern that the key has: grouped by value, they count distinct ones.
            value = lambda p: "regexp_replace(value, '[^0-9]', '')" if "cnic" in p.lower() else "trim(value)"
            listed = [*(["named_struct('pattern', -1, 'value', CAST(NULL AS STRING))"] if holds else []), *(f"if(contains(key, {quoted(p)}) AND value IS NOT NULL, named_struct('pattern', {i}, 'value', {value(p)}), NULL)" for i, p in enumerate(c.patterns))]
            rows = f.facts.select("case_id", *c.numbers(holds), F.expr(f"explode(array_compact(array({', '.join(listed)})))").alias("_v"))
            rows = rows.select("case_id", *c.names, F.col("_v.pattern").alias("_pattern"), F.col("_v.value").alias("_value"))
            values = rows.groupBy("case_id", "_pattern", "_value").agg(*[F.bit_or(n).alias(n) for n in c.names]) if c.names else rows.distinct()
            out.append(values.drop("_value"))
    return out


def _fires(r: Rule, c: _Conditions) -> tuple[str, str]:
    """Whether a rule fires on a case, and its evidence, both in SQL."""
    nothing = "CAST(NULL AS STRING)"
    lacks = f"NOT {c.any('type', *(q.lower() for q in r.required))}" if r.evaluator in ("missing_evidence", "constructed_gate") else ""
    match r.evaluator:
        case "mismatch":  # more than one distinct value under keys with the pattern; identity numbers count by their digits
            n = f"_values{c.patterns.index(r.pattern)}"
            return f"{n} > 1", f"CAST({n} AS STRING)"
        case "keyword_risk":
            listed = [f"if({c.words((k,))}, {quoted(k)}, NULL)" for k in sorted(set(r.keywords))]
            return c.words(r.keywords), f"concat_ws(', ', {', '.join(listed)})" if listed else nothing
        case "constructed_gate":  # built by the dossier or a page, and no required type is there
            return f"({c.any('built', '')} OR {c.words(r.indicators)}) AND {lacks}", nothing
        case "timeline_gap":  # kept for its name: it never fires
            return "FALSE", nothing
        case "verification_check":  # not verified, and a key with a value or a keyword calls for it; evidence is the first such page
            called = f"({c.any('key', *r.keys)} OR {c.words(r.keywords)})"
            first = f"concat('page ', _first{c.firsts.index(r.keywords)})" if r.keywords else nothing
            return f"{called} AND NOT {c.any('check', (r.kind, 'Verified'))}", f"concat_ws(' ', {first}, if({c.any('check', (r.kind, 'Failed'))}, 'failed', NULL))"
        case _:  # missing_evidence: no required type is among the case's; without required types it always fires
            return lacks, nothing


def required_regimes(rule: Rule) -> list[str]:
    """The structured list, else what `if regime == X` names; other conditions don't restrict."""
    first = re.search(r"(?i)if\s+regime\s*==\s*([A-Za-z0-9_]+)", rule.conditional)
    return [r.upper() for r in rule.regimes] or ([first[1].upper()] if first else [])


def evaluate(rules: list[Rule], f: Facts) -> DataFrame:
    """(case_id, rule_id, evidence, severity) of every rule that fires on a case of its regimes.

    Rules are compiled into conditions on single rows, each a bit.  Every fact
    table is read once, its rows become numbers of bits, and one aggregate by
    case joins them; rules are read off a case's bits after that.  More rules
    mean wider numbers, not more scans or exchanges.
    """
    rules = [r if r.evaluator in EVALUATORS else replace(r, evaluator="missing_evidence") for r in rules]
    c = _Conditions(rules)
    both = f.cases.select("case_id", F.upper("regime").alias("_regime"), F.lit(True).alias("_case"))
    for part in _signals(c, f):
        both = both.unionByName(part, allowMissingColumns=True)
    have = set(both.columns)
    count = lambda i: F.count(F.when(F.col("_pattern") == i, 1)) if "_pattern" in have else F.lit(0)
    cases = both.groupBy("case_id").agg(
        F.max("_case").alias("_case"),
        F.max("_regime").alias("_regime"),
        *[F.coalesce(F.bit_or(n) if n in have else F.lit(0).cast("long"), F.lit(0).cast("long")).alias(n) for n in c.names],
        *[F.min(f"_first{i}").alias(f"_first{i}") for i in range(len(c.firsts))],
        *[count(i).alias(f"_values{i}") for i in range(len(c.patterns))],
    ).where("_case")
    listed = []
    for r in rules:
        fires, evidence = _fires(r, c)
        gate = required_regimes(r)
        allowed = f"_regime IN ({', '.join(map(quoted, gate))}) AND " if gate else ""
        listed.append(f"if({allowed}{fires}, named_struct('rule_id', {quoted(r.id)}, 'evidence', {evidence}, 'severity', {quoted(r.severity)}), NULL)")
    return cases.select("case_id", F.expr(f"explode(array_compact(array({', '.join(listed)})))").alias("_r")).select("case_id", "_r.rule_id", "_r.evidence", "_r.severity")


def replace_open(old: DataFrame, fired: DataFrame) -> DataFrame:
    """Results after a run: what was resolved or waived stays, open results give way to what fired."""
    return old.where("status <> 'Open'").select("case_id", "rule_id", "severity", "status").unionByName(fired.select("case_id", "rule_id", "severity", F.lit("Open").alias("status")))


#: The regimes, and the names they go by, tried in this order.
REGIMES = ("REVENUE", "SOCIETY", "LDA", "RUDA", "DHA", "CANTONMENT", "MUNICIPAL", "UNKNOWN")
ALIASES = [
    ("LDA", "LDA"), ("LAHORE DEVELOPMENT AUTHORITY", "LDA"), ("DHA", "DHA"), ("DEFENCE HOUSING AUTHORITY", "DHA"), ("DHA PHASE", "DHA"),
    ("RUDA", "RUDA"), ("RAVI URBAN DEVELOPMENT AUTHORITY", "RUDA"), ("CANTONMENT", "CANTONMENT"), ("CANTONMENT BOARD", "CANTONMENT"), ("CB", "CANTONMENT"),
    ("SOCIETY", "SOCIETY"), ("COOPERATIVE SOCIETY", "SOCIETY"), ("REVENUE", "REVENUE"), ("LAND REVENUE", "REVENUE"),
    ("MUNICIPAL", "MUNICIPAL"), ("MUNICIPALITY", "MUNICIPAL"), ("TMA", "MUNICIPAL"), ("MC", "MUNICIPAL"),
]


def normalized_regime(value: Column) -> Column:
    """The exact name, else that of the first alias contained in the value, else UNKNOWN; null without a value."""
    up = F.upper(F.trim(value))
    out = F.when(value.isNull() | (value == ""), F.lit(None).cast("string")).when(up.isin(*REGIMES), up)
    for alias, name in ALIASES:
        out = out.when(up.contains(alias), name)
    return out.otherwise("UNKNOWN")


#: Fixed values: (regime, score, where it is looked for, terms); `kind is` compares whole document types.
INDICATORS = [
    ("DHA", 0.9, ("kind", "file"), ("dha",)), ("DHA", 0.8, ("text",), ("dha", "defence housing")), ("DHA", 0.85, ("scheme",), ("dha",)),
    ("LDA", 0.9, ("kind", "file"), ("lda",)), ("LDA", 0.8, ("text",), ("lda", "lahore development", "placement letter")), ("LDA", 0.85, ("scheme",), ("lda",)),
    ("RUDA", 0.9, ("kind", "file"), ("ruda",)), ("RUDA", 0.8, ("text",), ("ruda", "ravi urban")),
    ("CANTONMENT", 0.8, ("text",), ("cantonment board", "cb ", "leasehold")), ("CANTONMENT", 0.9, ("kind", "file"), ("cantonment",)),
    ("SOCIETY", 0.9, ("kind",), ("society",)), ("SOCIETY", 0.7, ("text",), ("society", "membership", "allotment")),
    ("REVENUE", 0.8, ("text",), ("fard", "jamabandi", "khasra", "khewat", "mouza")), ("REVENUE", 0.9, ("kind",), ("fard",)), ("REVENUE", 0.9, ("kind is",), ("jamabandi", "mutation")),
    ("MUNICIPAL", 0.7, ("text",), ("municipal", "tma", "mc ", "property tax", "pt-1")),
]
KNOWN_SCORE = 0.9


def classified_regime(cases: DataFrame, documents: DataFrame, pages: DataFrame, overwrite: bool = False) -> DataFrame:
    """(case_id, regime, score) of each case: a regime in its dossier stands, else the regime of the highest indicator.

    cases (case_id, regime, scheme); documents (case_id, doc_type, filename);
    pages (case_id, text).  Every table is read once: a row's best score for
    each regime is an expression, and a case's is its maximum.  Of equal scores
    the regime listed first wins; a page's end counts as a blank.
    """
    order = list(dict.fromkeys(i[0] for i in INDICATORS))

    def scores(df: DataFrame, **columns: Column) -> DataFrame:
        out = []
        for name in order:
            best = F.lit(0.0)
            for regime, score, places, terms in INDICATORS:
                for place in places if regime == name else ():
                    column = columns.get(place)
                    if column is not None:
                        low, hit = F.lower(column), F.lit(False)
                        for term in terms:
                            hit = hit | ((low == term) if place == "kind is" else low.contains(term))
                        best = F.greatest(best, F.when(F.coalesce(hit, F.lit(False)), score).otherwise(0.0))
            out.append(best.alias(name))
        return df.select("case_id", *out).groupBy("case_id").agg(*[F.max(n).alias(n) for n in order])

    parts = [scores(documents, **{"kind": F.col("doc_type"), "kind is": F.col("doc_type"), "file": F.col("filename")}), scores(pages, text=F.concat("text", F.lit(" "))), scores(cases, scheme=F.col("scheme"))]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("case_id").agg(*[F.max(n).alias(n) for n in order])
    top = F.array_max(F.array(*[F.struct(F.col(n).alias("score"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(order)]))
    known = normalized_regime(F.col("regime"))
    stands = F.lit(not overwrite) & known.isNotNull() & (known != "UNKNOWN")
    x = cases.select("case_id", "regime").join(merged.select("case_id", top.alias("top")), "case_id", "left")
    found = F.coalesce(F.col("top.score"), F.lit(0.0))
    return x.select("case_id", F.when(stands, known).when(found > 0, F.col("top.name")).otherwise("UNKNOWN").alias("regime"), F.when(stands, KNOWN_SCORE).otherwise(found).alias("score"))


def inferred_type(filename: Column, pairs: list[tuple[tuple[str, ...], str]]) -> Column:
    """The type of the first pair with a pattern in the file name."""
    low, out = F.lower(filename), F
    for patterns, kind in pairs:
        hit = low.contains(patterns[0])
        for p in patterns[1:]:
            hit = hit | low.contains(p)
        out = out.when(hit, kind)
    return out.otherwise(None)
