import hashlib
import random
import re

import pyarrow as pa

from ledgerloom.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    d = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda x: sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(x[::-1])) % 10 == 0
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(d(m.group())) <= 19 and luhn(d(m.group()))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(d(m.group())) <= 15]
    return out


def test_base_spans_equal_brute_force():
    rng = random.Random(1)
    parts = ["a.b+c@x-y.co.uk", "a@b.c@d.e", "@x.y", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "001.02.3.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5 5", "+1 (243) 555-5526", "+49.123-", "++1 234567890", "é", "\n", " ", ".", "12", "@", "-", "x", "٣"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert P.base_spans(t) == brute(t), t


def test_summary_and_given_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "call (212) 555-0199 now"), (902, "call (212) 555-0199 now"), (903, "write to jane.doe [at] mail [dot] com today"), (904, "9" * 30000 + " a@b.c")], "doc_id long, text string")
    rows = df.unionByName(extra)
    texts = {}
    for r in rows.collect():
        texts[r.doc_id] = r.text or ""
    got = P.summary(P.find(rows, ["doc_id"])).collect()
    assert len(got) == rows.count()
    for r in got:
        base = brute(texts[r.doc_id]) if r.doc_id != 904 else [("email", 30001, 30006)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in P.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}
    by = {r.doc_id: r for r in got}
    assert by[902].spans.startswith("phone:") and by[903].spans.startswith("email:")


def test_trees_on_fresh_examples():
    x, y, kind = P.examples(1500, seed=77)
    m = P.trained()
    p = m.probability(x)
    chosen = p >= [m.threshold[P.KINDS[k]] for k in kind]
    assert y[chosen].mean() > 0.96 and chosen[y == 1].mean() > 0.6


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or 10.0.0.1!", "en", "s", 24), (2, None, None, "s", None), (3, "clean text 2024", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in P.redact(df).collect()}
    assert got[1].text == "mail <EMAIL> or <IP>!" and got[1].n_chars == 21
    assert got[2].text is None and got[3].text == "clean text 2024"
    assert P.redact(df).columns == df.columns and P.find(df.limit(0)).count() == 0


def test_written_out_address_without_other_signs(spark):
    texts = ["write to jane.doe [at] mail.com today", "write to jane.doe at mail.com today", "reach jane.doe (AT) mail (DOT) org now", "host fe:dc:ba:ab:cd:ef:fa:ce is up", "nothing at all here. or there"]
    for t in texts[:4]:
        kind = "ip" if "host" in t else "email"
        assert any(k == kind and P._WIDE[kind].search(t).span() == (s, e) for k, s, e in P.candidates(t)), t
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.summary(P.find(df, ["doc_id"])).collect()}
    assert got[0] == "email:9:31" and got[2].startswith("email:")
    part = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert P._spans(part, P.trained()) == P.spans_of(texts, P.trained())  # the text's gate loses nothing
    alone, beside = P.candidates(texts[0]), P.candidates(texts[0] + " @")
    assert [c for c in beside if c in alone] == alone
