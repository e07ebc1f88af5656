"""Queries of the rule engine (R), over parts as documents and order lines as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables
from ..operators import kpis as K
from ..operators import rules as R
from ..registry import query
from ..sources import packs

#: What the cases' dossiers say of their regime: every name, ties of two names, odd spellings and nothing.
REGIME_TEXTS = [
    "DHA Phase 5", "lda", "some ruda area", None, "", "  ", "LDA / DHA", "DHA near LDA", "CB Lahore", "mc road", "Housing scheme", "Cantt", "tma city", "Municipality of X", "land revenue", "Revenue",
    "cooperative society", " society ", "Cantonment Board", "Ravi Urban Development Authority", "lahore development authority", "Defence Housing Authority", "unknown", "Patwari", "RUDA society", "revenue and society", "McB", "MUNICIPAL", "DEFENCE HOUSING", "Lahore Development",
]


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _nth(values: list, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))


_REGIME = f"({_list(REGIME_TEXTS)})[case_id % {len(REGIME_TEXTS)} + 1]"
_ALIASES = "[" + ", ".join(f"{{'a': '{a}', 'r': '{r}'}}" for a, r in R.ALIASES) + "]"
_NORM = f"CASE WHEN {_REGIME} <> '' THEN CASE WHEN upper(trim({_REGIME})) IN ('REVENUE', 'SOCIETY', 'LDA', 'RUDA', 'DHA', 'CANTONMENT', 'MUNICIPAL', 'UNKNOWN') THEN upper(trim({_REGIME})) ELSE coalesce(list_filter({_ALIASES}, lambda x: contains(upper(trim({_REGIME})), x.a))[1].r, 'UNKNOWN') END END"
_DOCS = "SELECT l_orderkey AS case_id, p_type AS doc_type FROM lineitem JOIN part ON p_partkey = l_partkey"
_FACTS = "SELECT l_orderkey AS case_id, CASE WHEN l_linenumber % 2 = 0 THEN 'party.cnic' ELSE 'registry.number' END AS key, '12-' || (l_partkey % 3) || ' x' AS value FROM lineitem"
_CHECKS = "SELECT case_id, verification_type AS kind, status FROM verifications"
_PG = "SELECT doc_id AS case_id, line_no AS page, line AS text FROM lines"


def facts(t: Tables) -> R.Facts:
    line = t.raw("lineitem")
    return R.Facts(
        cases=t.cases.select("case_id", R.normalized_regime(_nth(REGIME_TEXTS, F.col("case_id"))).alias("regime")),
        facts=line.select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") % 2 == 0, "party.cnic").otherwise("registry.number").alias("key"), F.concat(F.lit("12-"), (F.col("l_partkey") % 3).cast("string"), F.lit(" x")).alias("value")),
        documents=line.join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("case_id"), F.col("p_type").alias("doc_type")),
        pages=t.lines.select(F.col("doc_id").alias("case_id"), "doc_id", F.col("line_no").alias("page"), F.col("line").alias("text")),
        checks=t.verifications.select("case_id", F.col("verification_type").alias("kind"), "status"),
    )


def _run(t: Tables, *rules: R.Rule) -> DataFrame:
    return R.evaluate(list(rules), facts(t)).select("case_id", "rule_id", "evidence")


@query("R01_context", f"WITH d AS ({_DOCS}), f AS ({_FACTS}), k AS ({_CHECKS}) SELECT c.case_id, (SELECT count(*) FROM d WHERE d.case_id = c.case_id) AS documents, (SELECT count(*) FROM f WHERE f.case_id = c.case_id AND value <> '') AS facts, (SELECT count(*) FROM k WHERE k.case_id = c.case_id) AS checks FROM cases c".replace("AS documents", "AS n_documents").replace("AS facts", "AS n_facts").replace("AS checks", "AS n_checks"))
def context(t: Tables) -> DataFrame:
    f = facts(t)
    out = f.cases.select("case_id")
    for name, df in (("n_documents", f.documents), ("n_facts", f.facts.where("value <> ''")), ("n_checks", f.checks)):
        out = out.join(df.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left")
    return out.na.fill(0)


_PAIRS = [(("sale", "deed"), "sale_deed"), (("steel", "tin"), "metal"), (("economy",), "economy"), (("promo",), "promo")]


@query("R02_inferred_type", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'sale') OR contains(lower(p_type), 'deed') THEN 'sale_deed' WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'metal' WHEN contains(lower(p_type), 'economy') THEN 'economy' WHEN contains(lower(p_type), 'promo') THEN 'promo' END AS v FROM part")
def inferred_type(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", R.inferred_type(F.col("p_type"), _PAIRS).alias("v"))


@query("R03_effective_type", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, ''), CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'metal' WHEN contains(lower(p_type), 'economy') THEN 'economy' WHEN contains(lower(p_type), 'promo') THEN 'promo' END) AS v FROM part")
def effective_type(t: Tables) -> DataFrame:
    given = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand"))
    return t.raw("part").select("p_partkey", F.coalesce(F.nullif(given, F.lit("")), R.inferred_type(F.col("p_type"), _PAIRS)).alias("v"))


@query("R04_missing_evidence", f"WITH d AS ({_DOCS}) SELECT case_id, 'M' AS rule_id, CAST(NULL AS VARCHAR) AS evidence FROM cases c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.case_id = c.case_id AND (contains(lower(doc_type), 'steel') OR contains('steel', lower(doc_type)) OR contains(lower(doc_type), 'brass') OR contains('brass', lower(doc_type))))")
def missing_evidence(t: Tables) -> DataFrame:
    return _run(t, R.Rule("M", "missing_evidence", required=("STEEL", "Brass")))


@query("R05_mismatch", f"WITH f AS ({_FACTS}) SELECT case_id, 'X' AS rule_id, CAST(count(DISTINCT regexp_replace(value, '[^0-9]', '', 'g')) AS VARCHAR) AS evidence FROM f WHERE contains(key, 'cnic') AND case_id IN (SELECT case_id FROM cases) GROUP BY case_id HAVING count(DISTINCT regexp_replace(value, '[^0-9]', '', 'g')) > 1")
def mismatch(t: Tables) -> DataFrame:
    return _run(t, R.Rule("X", "mismatch", pattern="cnic"))


@query("R06_keyword_risk", f"WITH p AS ({_PG}), h AS (SELECT DISTINCT case_id, w FROM p, (VALUES ('license'), ('token')) k(w) WHERE contains(lower(text), w)) SELECT case_id, 'K' AS rule_id, string_agg(w, ', ' ORDER BY w) AS evidence FROM h WHERE case_id IN (SELECT case_id FROM cases) GROUP BY case_id")
def keyword_risk(t: Tables) -> DataFrame:
    return _run(t, R.Rule("K", "keyword_risk", keywords=("token", "license")))


@query("R06b_evidence_references", f"WITH p AS ({_PG}) SELECT case_id, 'K' AS rule_id, case_id AS doc_id, page, 'Contains keyword: ' || CASE WHEN contains(lower(text), 'token') THEN 'token' ELSE 'license' END AS note FROM p WHERE (contains(lower(text), 'token') OR contains(lower(text), 'license')) AND case_id IN (SELECT case_id FROM cases)")
def evidence_references(t: Tables) -> DataFrame:
    return R.keyword_references(R.Rule("K", "keyword_risk", keywords=("token", "license")), facts(t))


@query("R07_constructed_gate", f"WITH p AS ({_PG}), d AS ({_DOCS}) SELECT case_id, 'G' AS rule_id, CAST(NULL AS VARCHAR) AS evidence FROM cases c WHERE EXISTS (SELECT 1 FROM p WHERE p.case_id = c.case_id AND contains(lower(text), 'the')) AND NOT EXISTS (SELECT 1 FROM d WHERE d.case_id = c.case_id AND (contains(lower(doc_type), 'steel') OR contains('steel', lower(doc_type))))")
def constructed_gate(t: Tables) -> DataFrame:
    return _run(t, R.Rule("G", "constructed_gate", required=("steel",), indicators=("the",)))


@query("R08_timeline_gap", "SELECT case_id, 'T' AS rule_id, CAST(NULL AS VARCHAR) AS evidence FROM cases WHERE FALSE")
def timeline_gap(t: Tables) -> DataFrame:
    return _run(t, R.Rule("T", "timeline_gap"))


@query("R09_verification_check", f"WITH f AS ({_FACTS}), k AS ({_CHECKS}), p AS ({_PG}), a AS (SELECT case_id, CAST(NULL AS INTEGER) AS page FROM f WHERE contains(key, 'registry') UNION ALL SELECT case_id, page FROM p WHERE contains(lower(text), 'token')), g AS (SELECT case_id, min(page) AS page FROM a GROUP BY 1) SELECT c.case_id, 'V' AS rule_id, concat_ws(' ', 'page ' || page, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.case_id = c.case_id AND kind = 'registry' AND k.status = 'Failed') THEN 'failed' END) AS evidence FROM cases c JOIN g USING (case_id) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.case_id = c.case_id AND kind = 'registry' AND k.status = 'Verified')")
def verification_check(t: Tables) -> DataFrame:
    return _run(t, R.Rule("V", "verification_check", kind="registry", keys=("registry",), keywords=("token",)))


@query("R10_case_regime", f"SELECT case_id, {_NORM} AS regime FROM cases WHERE {_NORM} <> 'UNKNOWN'")
def case_regime(t: Tables) -> DataFrame:
    return facts(t).cases.where("regime <> 'UNKNOWN'")


@query("R11_required_regimes", "SELECT * FROM (VALUES ('ID-1', ''), ('TI-1', ''), ('TI-2', ''), ('TI-3', ''), ('AU-1', 'LDA,DHA'), ('AU-2', 'RUDA'), ('AU-3', '')) x(rule_id, regimes)")
def required_regimes(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(r.id, ",".join(R.required_regimes(r))) for r in pack()], "rule_id string, regimes string")


@query("R12_regime_gate", f"SELECT case_id, 'E' AS rule_id, CAST(NULL AS VARCHAR) AS evidence FROM cases WHERE {_NORM} = 'RUDA'")
def regime_gate(t: Tables) -> DataFrame:
    return _run(t, R.Rule("E", "missing_evidence", conditional="if regime == RUDA"))


@query("R13_dispatch", f"WITH d AS ({_DOCS}) SELECT case_id, 'U' AS rule_id, CAST(NULL AS VARCHAR) AS evidence FROM cases c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.case_id = c.case_id AND (contains(lower(doc_type), 'steel') OR contains('steel', lower(doc_type)))) UNION ALL SELECT case_id, 'E', NULL FROM cases WHERE {_NORM} = 'LDA'")
def dispatch(t: Tables) -> DataFrame:
    good, _ = R.validated([{"id": "U", "module": "m", "severity": "Low", "evaluator": "no such", "logic": {"required_doc_types": ["steel"]}}, {"id": "E", "module": "m", "severity": "Low", "logic": {"regimes": ["LDA"]}}, {"id": "bad", "severity": "Critical"}, {}])
    return _run(t, *good)


@query("R14_summary", "SELECT lower(severity) AS severity, count(*) AS n, count(CASE WHEN status = 'Open' THEN 1 END) AS cps FROM cps GROUP BY 1".replace("AS cps", "AS n_open"))
def summary(t: Tables) -> DataFrame:
    return t.cps.groupBy(F.lower("severity").alias("severity")).agg(F.count("*").alias("n"), K.n(F.col("status") == "Open", "n_open"))


@query("R15_auto_satisfy", "SELECT c.case_id, c.line, CASE WHEN c.status = 'Open' AND EXISTS (SELECT 1 FROM verifications v WHERE v.case_id = c.case_id AND v.status = 'Verified') THEN 'Satisfied' ELSE c.status END AS status FROM cps c")
def auto_satisfy(t: Tables) -> DataFrame:
    ok = t.verifications.where("status = 'Verified'").select("case_id").distinct().withColumn("ok", F.lit(True))
    return t.cps.join(ok, "case_id", "left").select("case_id", "line", F.when((F.col("status") == "Open") & F.col("ok"), "Satisfied").otherwise(F.col("status")).alias("status"))


_KINDS = ["DHA NDC", "lda_transfer", "RUDA letter", "cantonment_noc", "society_transfer", "Fard", "jamabandi", "mutation", "old mutation", "sale_deed", "cnic", "map", "photo", "challan", "receipt", None]
_FILES = ["scan.pdf", "dha.pdf", "LDA plan.pdf", "ruda-1.pdf", "Cantonment.pdf", "society.pdf", "fard.pdf", "a.pdf", "b.pdf", "c.pdf", "d.pdf", "e.pdf", None]
_PAGES = ["a Defence Housing plot", "placement letter", "Ravi Urban area", "leasehold", "seen by cb", "cbx only", "membership and Allotment", "Khewat no 5", "mouza", "property tax", "PT-1 form", "mc", "nothing", "text", "of", "no", "worth", "here", "and", "there", None]
_SCHEMES = ["DHA Phase 6", "LDA Avenue", "both LDA and DHA", "Green Town", None, "Canal View", "Sun City"]
_ROWS = f"SELECT l_orderkey AS case_id, lower(({_list(_KINDS)})[(l_partkey + 3 * l_orderkey) % {len(_KINDS)} + 1]) AS k, lower(({_list(_FILES)})[l_suppkey % {len(_FILES)} + 1]) AS f, lower(({_list(_PAGES)})[(l_partkey + l_linenumber) % {len(_PAGES)} + 1]) || ' ' AS x FROM lineitem"


def _any(column: str, terms: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in terms.split("|")) + ")"


_SCORES = {
    "DHA": f"max(CASE WHEN {_any('k', 'dha')} OR {_any('f', 'dha')} THEN 0.9 WHEN {_any('x', 'dha|defence housing')} THEN 0.8 ELSE 0 END)",
    "LDA": f"max(CASE WHEN {_any('k', 'lda')} OR {_any('f', 'lda')} THEN 0.9 WHEN {_any('x', 'lda|lahore development|placement letter')} THEN 0.8 ELSE 0 END)",
    "RUDA": f"max(CASE WHEN {_any('k', 'ruda')} OR {_any('f', 'ruda')} THEN 0.9 WHEN {_any('x', 'ruda|ravi urban')} THEN 0.8 ELSE 0 END)",
    "CANTONMENT": f"max(CASE WHEN {_any('k', 'cantonment')} OR {_any('f', 'cantonment')} THEN 0.9 WHEN {_any('x', 'cantonment board|cb |leasehold')} THEN 0.8 ELSE 0 END)",
    "SOCIETY": f"max(CASE WHEN {_any('k', 'society')} THEN 0.9 WHEN {_any('x', 'society|membership|allotment')} THEN 0.7 ELSE 0 END)",
    "REVENUE": f"max(CASE WHEN {_any('k', 'fard')} OR k IN ('jamabandi', 'mutation') THEN 0.9 WHEN {_any('x', 'fard|jamabandi|khasra|khewat|mouza')} THEN 0.8 ELSE 0 END)",
    "MUNICIPAL": f"max(CASE WHEN {_any('x', 'municipal|tma|mc |property tax|pt-1')} THEN 0.7 ELSE 0 END)",
}
_SCHEME = f"lower(({_list(_SCHEMES)})[case_id % {len(_SCHEMES)} + 1])"
_BEST = f"""SELECT c.case_id, {_NORM.replace('case_id', 'c.case_id')} AS known, [{', '.join(f"{{'n': '{n}', 's': " + (f"greatest(coalesce({n}, 0), CASE WHEN contains({_SCHEME.replace('case_id', 'c.case_id')}, '{n.lower()}') THEN 0.85 ELSE 0 END)" if n in ('DHA', 'LDA') else f"coalesce({n}, 0)") + "}" for n in _SCORES)}] AS l FROM cases c LEFT JOIN (SELECT case_id, {', '.join(f'{v} AS {n}' for n, v in _SCORES.items())} FROM ({_ROWS}) GROUP BY case_id) s ON s.case_id = c.case_id"""


@query("R16_regime_classifier", f"SELECT case_id, CASE WHEN known <> 'UNKNOWN' THEN known WHEN m = 0 THEN 'UNKNOWN' ELSE list_filter(l, lambda z: z.s = m)[1].n END AS regime, CAST(CASE WHEN known <> 'UNKNOWN' THEN 0.9 ELSE m END AS DOUBLE) AS score FROM (SELECT *, list_max(list_transform(l, lambda z: z.s)) AS m FROM ({_BEST}))")
def regime_classifier(t: Tables) -> DataFrame:
    line = t.raw("lineitem")
    case = F.col("l_orderkey").alias("case_id")
    cases = t.cases.select("case_id", _nth(REGIME_TEXTS, F.col("case_id")).alias("regime"), _nth(_SCHEMES, F.col("case_id")).alias("scheme"))
    documents = line.select(case, _nth(_KINDS, F.col("l_partkey") + 3 * F.col("l_orderkey")).alias("doc_type"), _nth(_FILES, F.col("l_suppkey")).alias("filename"))
    return R.classified_regime(cases, documents, line.select(case, _nth(_PAGES, F.col("l_partkey") + F.col("l_linenumber")).alias("text")))


@query("R17_normalized_regime", f"SELECT case_id, {_NORM} AS regime FROM cases")
def normalized_regime(t: Tables) -> DataFrame:
    return facts(t).cases


@query("R18_checklist", f"WITH d AS ({_DOCS}) SELECT c.case_id, k AS item, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.case_id = c.case_id AND lower(d.doc_type) = k) THEN 'Provided' ELSE 'Missing' END AS status FROM cases c, (VALUES ('economy'), ('promo')) x(k)")
def checklist(t: Tables) -> DataFrame:
    """One aggregate of what each case has; the few items are constants."""
    have = facts(t).documents.where(F.lower("doc_type").isin("economy", "promo")).groupBy("case_id").agg(F.collect_set(F.lower("doc_type")).alias("have"))
    item = F.explode(F.array(F.lit("economy"), F.lit("promo"))).alias("item")
    return t.cases.join(have, "case_id", "left").select("case_id", "have", item).select("case_id", "item", F.when(F.coalesce(F.array_contains("have", F.col("item")), F.lit(False)), "Provided").otherwise("Missing").alias("status"))


@query("R19_closure_evidence", "SELECT rule_id, min(CASE WHEN rule_id = 'R-1' THEN 'deed, map' WHEN rule_id = 'R-2' THEN 'a, b' WHEN rule_id = 'R-5' THEN 'x, y, z' ELSE 'supporting document' END) AS evidence FROM exceptions GROUP BY rule_id")
def closure_evidence(t: Tables) -> DataFrame:
    """What the library accepts, else the rule's own text split at its separators, else a general answer."""
    library = packs.evidence_library(t.spark, packs.HOME / "evidence.yaml").where(F.size("acceptable_evidence") > 0).select("rule_id", F.col("acceptable_evidence").alias("listed"))
    own = F.when(F.col("rule_id") == "R-5", "x; y, z")
    split = F.filter(F.transform(F.split(own, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    rules = t.exceptions.select("rule_id").distinct().join(F.broadcast(library), "rule_id", "left")
    return rules.select("rule_id", F.array_join(F.coalesce("listed", split, F.array(F.lit("supporting document"))), ", ").alias("evidence"))


@query("R20_side_effects", "SELECT e.case_id, e.line, CASE WHEN e.status = 'Open' AND EXISTS (SELECT 1 FROM approvals a WHERE a.case_id = e.case_id AND a.request_type = 'exception_waive' AND a.status = 'Approved') THEN 'Waived' ELSE e.status END AS status FROM exceptions e")
def side_effects(t: Tables) -> DataFrame:
    yes = t.approvals.where("request_type = 'exception_waive' AND status = 'Approved'").select("case_id").distinct().withColumn("yes", F.lit(True))
    return t.exceptions.join(yes, "case_id", "left").select("case_id", "line", F.when((F.col("status") == "Open") & F.col("yes"), "Waived").otherwise(F.col("status")).alias("status"))


@query("R21_replace_open", f"WITH d AS ({_DOCS}) SELECT case_id, rule_id, severity, status FROM exceptions WHERE status <> 'Open' UNION ALL SELECT case_id, 'M', 'High', 'Open' FROM cases c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.case_id = c.case_id AND (contains(lower(doc_type), 'steel') OR contains('steel', lower(doc_type))))")
def replace_open(t: Tables) -> DataFrame:
    return R.replace_open(t.exceptions, R.evaluate([R.Rule("M", "missing_evidence", severity="High", required=("steel",))], facts(t)))


def pack() -> list[R.Rule]:
    return R.validated(packs.rule_list(packs.HOME / "rules.yaml"))[0]


@query("R22_rulepack_run", f"WITH f AS ({_FACTS}), p AS ({_PG}), d AS ({_DOCS}), k AS ({_CHECKS}) SELECT 'ID-1' AS rule_id, 'High' AS severity, count(*) AS n FROM (SELECT case_id FROM f WHERE contains(key, 'cnic') AND case_id IN (SELECT case_id FROM cases) GROUP BY case_id HAVING count(DISTINCT regexp_replace(value, '[^0-9]', '', 'g')) > 1) UNION ALL SELECT 'TI-1', 'Medium', count(DISTINCT case_id) FROM p WHERE (contains(lower(text), 'token') OR contains(lower(text), 'license')) AND case_id IN (SELECT case_id FROM cases) UNION ALL SELECT 'TI-2', 'Low', count(DISTINCT case_id) FROM p WHERE contains(lower(text), 'the') AND case_id IN (SELECT case_id FROM cases) UNION ALL SELECT 'TI-3', 'High', count(*) FROM cases c WHERE (case_id IN (SELECT case_id FROM f WHERE contains(key, 'registry')) OR case_id IN (SELECT case_id FROM p WHERE contains(lower(text), 'token'))) AND case_id NOT IN (SELECT case_id FROM k WHERE kind = 'registry' AND status = 'Verified') UNION ALL SELECT 'AU-1', 'High', count(*) FROM cases WHERE {_NORM} IN ('LDA', 'DHA') AND case_id NOT IN (SELECT case_id FROM d WHERE contains(lower(doc_type), 'steel') OR contains('steel', lower(doc_type))) UNION ALL SELECT 'AU-2', 'High', count(*) FROM cases WHERE {_NORM} = 'RUDA' AND case_id NOT IN (SELECT case_id FROM d WHERE contains(lower(doc_type), 'brass') OR contains('brass', lower(doc_type)))")
def rulepack_run(t: Tables) -> DataFrame:
    """The whole pack that comes with the library, over all cases."""
    return R.evaluate(pack(), facts(t)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


_TYPES = ["economy", "large", "standard", "promo", "small", "medium"]
_SYLLABLES = ["license", "token", "anon", "erth", "ouan", "stbl", "ingre", "nder", "haou", "enly", "ress", "atha", "onnd", "thth", "edre", "waso", "ition", "hewh", "strea", "andi", "orly", "esha", "blen", "ofen", "inth", "toou", "lyed", "ndst", "rewh", "hein", "thea", "ating", "ereh"]


def wide_pack(n: int = 57) -> list[R.Rule]:
    """A pack as large as a user's: all evaluators in turn, some for two regimes only."""
    word = lambda k: _SYLLABLES[k % len(_SYLLABLES)]
    out = []
    for k in range(n):
        common = {"id": f"W-{k:02d}", "severity": ("High", "Medium", "Low")[k % 3], "regimes": ("lda", "DHA") if k % 6 == 0 else ()}
        out.append(
            (
                R.Rule(evaluator="keyword_risk", keywords=(word(k), word(k + 7)), **common),
                R.Rule(evaluator="missing_evidence", required=(_TYPES[k % 6], _TYPES[(k + 2) % 6]), **common),
                R.Rule(evaluator="mismatch", pattern=("cnic", "registry", "r.")[k % 3], **common),
                R.Rule(evaluator="verification_check", kind=("registry", "e_stamp", "registry_rod")[k % 3], keys=("registry",) if k % 4 == 0 else ("no such",), keywords=(word(k + 3), word(k + 4)), **common),
                R.Rule(evaluator="constructed_gate", required=(_TYPES[k % 6],), indicators=(word(k), word(k + 11)), **common),
            )[k % 5]
        )
    return out


def _rule_sql(r: R.Rule) -> str:
    """One rule as the source states it, over f, d, k, h (pages' words) and n (cases)."""
    having = lambda words: f"case_id IN (SELECT case_id FROM h WHERE w IN ({', '.join(repr(w) for w in words)}))"
    lacks = "case_id NOT IN (SELECT case_id FROM d WHERE " + " OR ".join(f"contains(lower(doc_type), '{q}') OR contains('{q}', lower(doc_type))" for q in r.required) + ")"
    value = "regexp_replace(value, '[^0-9]', '', 'g')" if "cnic" in r.pattern else "trim(value)"
    test = {
        "keyword_risk": having(r.keywords),
        "missing_evidence": lacks,
        "mismatch": f"case_id IN (SELECT case_id FROM f WHERE contains(key, '{r.pattern}') GROUP BY case_id HAVING count(DISTINCT {value}) > 1)",
        "verification_check": f"(case_id IN (SELECT case_id FROM f WHERE {' OR '.join(f"contains(key, '{x}')" for x in r.keys) or 'FALSE'}) OR {having(r.keywords)}) AND case_id NOT IN (SELECT case_id FROM k WHERE kind = '{r.kind}' AND status = 'Verified')",
        "constructed_gate": f"{having(r.indicators)} AND {lacks}",
    }[r.evaluator]
    gate = f"regime IN ({', '.join(repr(x.upper()) for x in r.regimes)}) AND " if r.regimes else ""
    return f"SELECT '{r.id}' AS rule_id, '{r.severity}' AS severity, count(*) AS n, sum(case_id) AS cases FROM n WHERE {gate}{test} HAVING count(*) > 0"


@query("R13b_wide_pack", f"WITH f AS ({_FACTS}), d AS ({_DOCS}), k AS ({_CHECKS}), h AS (SELECT DISTINCT case_id, w FROM ({_PG}), (VALUES {', '.join(f"('{w}')" for w in _SYLLABLES)}) x(w) WHERE contains(lower(text), w)), n AS (SELECT case_id, {_NORM} AS regime FROM cases) {' UNION ALL '.join(_rule_sql(r) for r in wide_pack())}".replace("AS cases", "AS case_sum"))
def wide_pack_run(t: Tables) -> DataFrame:
    """57 rules over all cases: one scan of each fact table, one aggregate by case."""
    return R.evaluate(wide_pack(), facts(t)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.sum("case_id").alias("case_sum"))


@query("S03_rulepack", "SELECT * FROM (VALUES ('ID-1', 'mismatch', 'High'), ('TI-1', 'keyword_risk', 'Medium'), ('TI-2', 'keyword_risk', 'Low'), ('TI-3', 'verification_check', 'High'), ('AU-1', 'missing_evidence', 'High'), ('AU-2', 'missing_evidence', 'High'), ('AU-3', 'timeline_gap', 'Low')) x(id, evaluator, severity)")
def rulepack(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(r.id, r.evaluator, r.severity) for r in pack()], "id string, evaluator string, severity string")


@query("S04_rulepack_errors", "SELECT * FROM (VALUES ('BAD-1: missing module'), ('BAD-2: invalid severity'), ('BAD-3: invalid severity'), ('rule missing id'), ('rule missing id')) x(error)")
def rulepack_errors(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(e,) for e in R.validated(packs.rule_list(packs.HOME / "rules.yaml"))[1]], "error string")


@query("S05_evidence_library", "SELECT * FROM (VALUES ('R-1', 'deed, map', '', 'all_of', FALSE, 'never', ''), ('R-2', 'a, b', 'c', 'any_of', TRUE, 'old entry', 'old entry'), ('R-3', '', '', 'any_of', TRUE, '', ''), ('R-4', '', '', 'any_of', TRUE, '', '')) x(rule_id, evidence, substitutes, closure_logic, waivable, waiver_guidance, notes)")
def evidence_library(t: Tables) -> DataFrame:
    e = packs.evidence_library(t.spark, packs.HOME / "evidence.yaml")
    return e.select("rule_id", F.array_join("acceptable_evidence", ", ").alias("evidence"), F.array_join("acceptable_substitutes", ", ").alias("substitutes"), "closure_logic", "waivable", "waiver_guidance", "notes")


@query("S06_playbooks", "SELECT * FROM (VALUES ('P-LDA', 'LDA', 'PLAN'), ('P-LDA', 'LDA', 'DEED'), ('P-BOTH', 'LDA', 'DEED'), ('P-BOTH', 'LDA', 'NDC'), ('P-BOTH', 'DHA', 'DEED'), ('P-BOTH', 'DHA', 'NDC')) x(playbook, regime, code)")
def playbooks(t: Tables) -> DataFrame:
    p = packs.playbooks(t.spark, packs.HOME / "playbooks.yaml").select("playbook", F.explode("regimes").alias("regime"), "evidence")
    return p.select("playbook", "regime", F.explode("evidence").alias("e")).select("playbook", "regime", F.col("e.code").alias("code"))
