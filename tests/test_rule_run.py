"""The one-pass rule run against each rule by itself, and its plan."""

import random
import re

import pytest

from ledgerloom.catalog import Tables
from ledgerloom.operators import rules as R
from ledgerloom.plans import rules as plans

SCHEMAS = {"cases": "case_id long, regime string", "facts": "case_id long, key string, value string", "documents": "case_id long, doc_type string", "pages": "case_id long, page int, text string", "checks": "case_id long, kind string, status string"}


def fired(rule, given):
    """(case, evidence) where one rule fires, stated plainly."""
    of = lambda name, case: [r[1:] for r in given[name] if r[0] == case]
    gate, out = R.required_regimes(rule), []
    for case, regime in given["cases"]:
        if gate and (regime or "").upper() not in gate:
            continue
        texts = [(p, t.lower()) for p, t in of("pages", case) if t is not None]
        words = lambda ks: sorted({k for k in ks for _, t in texts if k.lower() in t})  # noqa: E731, B023
        kinds = [d.lower() for (d,) in of("documents", case) if d is not None]
        lacks = not any(q.lower() in d or d in q.lower() for q in rule.required for d in kinds)
        facts = [(k, v) for k, v in of("facts", case) if k is not None and v is not None]
        if rule.evaluator == "mismatch":
            values = {re.sub("[^0-9]", "", v) if "cnic" in rule.pattern.lower() else v.strip(" ") for k, v in facts if rule.pattern in k}
            if len(values) > 1:
                out.append((case, str(len(values))))
        elif rule.evaluator == "keyword_risk":
            if words(rule.keywords):
                out.append((case, ", ".join(words(rule.keywords))))
        elif rule.evaluator == "constructed_gate":
            built = any(k == "property.constructed" and v.lower() in ("true", "yes", "1") for k, v in facts)
            if lacks and (built or words(rule.indicators)):
                out.append((case, None))
        elif rule.evaluator == "verification_check":
            states = {s for k, s in of("checks", case) if k == rule.kind}
            pages = [p for p, t in texts if any(k.lower() in t for k in rule.keywords)]
            if (pages or any(x in k and v.strip(" ") for x in rule.keys for k, v in facts)) and "Verified" not in states:
                out.append((case, " ".join([*([f"page {min(pages)}"] if pages else []), *(["failed"] if "Failed" in states else [])])))
        elif rule.evaluator != "timeline_gap" and lacks:
            out.append((case, None))
    return out


def random_pack(rng, words):
    some = lambda pool, k=3: tuple(rng.sample(pool, rng.randint(0, k)))
    pack = []
    for i in range(40):
        pack.append(R.Rule(f"r{i}", rng.choice([*R.EVALUATORS, "unheard of"]), severity=rng.choice(["High", "Low"]), required=some(["Deed", "map", "cnic copy", "fard"]), pattern=rng.choice(["cnic", "name", "CNIC", ""]), keywords=some(words), indicators=some(words), kind=rng.choice(["registry", "rod"]), keys=some(["cnic", "registry", "name"]), regimes=some(["lda", "DHA"], 2), conditional=rng.choice(["", "if regime == ruda then"])))
    return pack


@pytest.mark.parametrize("many", [1, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_pack_equals_single_rules(spark, monkeypatch, seed, many):
    monkeypatch.setattr(R, "MANY_WORDS", many)  # keywords by automaton, or one by one
    rng = random.Random(seed)
    words = ["ab", "BA", "aab", "b", "zz", "Abab", "b'a\\"]
    pick = lambda *values: rng.choice(values)
    given = {
        "cases": [(c, pick("LDA", "dha", "RUDA", None)) for c in range(30)],
        "facts": [(rng.randint(0, 33), pick("party.cnic", "CNIC.x", "registry.number", "name", "property.constructed", None), pick("1-2", "12", " a", "a", "", "yes", None)) for _ in range(150)],
        "documents": [(rng.randint(0, 33), pick("Sale Deed", "MAP", "cnic", "photo", None)) for _ in range(40)],
        "pages": [(rng.randint(0, 33), p, pick(None, "".join(rng.choice("abAB '\\") for _ in range(6)))) for p in range(80)],
        "checks": [(rng.randint(0, 33), pick("registry", "rod"), pick("Verified", "Failed", "Pending")) for _ in range(30)],
    }
    f = R.Facts(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in given.items()})
    pack = random_pack(rng, words)
    got = sorted(((r.rule_id, r.case_id, r.evidence, r.severity) for r in R.evaluate(pack, f).collect()), key=str)
    assert got == sorted(((r.id, *x, r.severity) for r in pack for x in fired(r, given)), key=str) and len(got) > 50


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Exchange hashpartitioning")


def test_scans_do_not_grow_with_rules(spark):
    f = plans.facts(Tables(spark, "/root/testdata/sf0.001"))
    few, many = (scans(R.evaluate(plans.wide_pack(n), f)) for n in (5, 57))
    assert few == many and many[0] <= 6  # cases, facts, pages, checks, and the two tables that documents are joined from


def test_no_rules_need_no_tables(spark):
    f = plans.facts(Tables(spark, "/root/testdata/sf0.001"))
    always = R.evaluate([R.Rule("a", "missing_evidence")], f)
    assert scans(always)[0] == 1 and always.count() == f.cases.count()
