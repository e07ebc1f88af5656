"""Queries of the evaluation family (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables
from ..functions.distance import page_distance as page_distances
from ..operators import evaluation as E
from ..operators import kpis as K
from ..operators import windows as W
from ..registry import query
from ..session import spread


def findings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All parts: 40 neighbouring keys are a case, whatever the size of the table; even keys are expected, odd ones found."""
    p = t.raw("part").select(F.floor(F.col("p_partkey") / 40).alias("case_id"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 6 < 2, F.col("p_brand")).alias("rule_id"), F.col("p_name").alias("title"), F.col("p_type").alias("text"))
    even = F.col("id") % 2 == 0
    return p.where(even), p.where(~even)


_TOK = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9_]+'), lambda w: length(w) > 2))"
_J = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


def _matching(case: str, expected: str, rule: str, text: str) -> str:
    """Greedy matching in SQL: a recursion takes the expectations of all cases one by one."""
    best = f"greatest({_J.format('e.a', 'o.a')}, 0.8 * {_J.format('e.b', 'o.b')})"
    return f"""RECURSIVE x AS (SELECT {case} AS case_id, p_partkey AS id, {expected} AS gold, {rule} AS rule_id, {_TOK.format('p_name')} AS a, {_TOK.format(text)} AS b FROM part),
        pairs AS (SELECT e.case_id, e.id AS e, o.id AS o, coalesce(e.rule_id <> '' AND e.rule_id = o.rule_id, FALSE) AS same, {best} AS s FROM x e JOIN x o ON e.case_id = o.case_id AND e.gold AND NOT o.gold),
        near AS (SELECT case_id, e, list({{'o': o, 's': CASE WHEN same THEN 1.0 ELSE s END}} ORDER BY same DESC, CASE WHEN same THEN 0 ELSE -s END, o) AS c FROM pairs WHERE same OR s >= 0.3 GROUP BY 1, 2),
        todo AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY e) AS k FROM near),
        step AS (SELECT DISTINCT case_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS o, CAST(NULL AS DOUBLE) AS s FROM todo
            UNION ALL SELECT n.case_id, n.k, CASE WHEN n.f IS NULL THEN n.taken ELSE list_append(n.taken, n.f.o) END, n.e, n.f.o, n.f.s FROM (SELECT t.case_id, t.k, p.taken, t.e, list_filter(t.c, lambda z: NOT list_contains(p.taken, z.o))[1] AS f FROM step p JOIN todo t ON t.case_id = p.case_id AND t.k = p.k + 1) n),
        m AS (SELECT case_id, e, o, s FROM step WHERE o IS NOT NULL),
        found AS (SELECT x.case_id, x.id AS expected_id, m.o AS actual_id, CASE WHEN m.o IS NULL THEN 'missed' ELSE 'matched' END AS status, round(coalesce(m.s, 0.0), 6) AS similarity FROM x LEFT JOIN m ON m.case_id = x.case_id AND m.e = x.id WHERE x.gold
            UNION ALL SELECT case_id, NULL, id, 'extra', 0.0 FROM x WHERE NOT gold AND NOT EXISTS (SELECT 1 FROM m WHERE m.case_id = x.case_id AND m.o = x.id))"""


_E01 = _matching("p_partkey // 40", "p_partkey % 2 = 0", "CASE WHEN p_partkey % 6 < 2 THEN p_brand END", "p_type")


@query("E01_golden_matching", f"WITH {_E01} SELECT * FROM found")
def golden_matching(t: Tables) -> DataFrame:
    return E.golden_matching(*findings(t)).withColumn("similarity", F.round("similarity", 6))


@query("J15_greedy_pairs", f"WITH {_matching('p_partkey // 24', 'p_partkey % 3 = 0', 'NULL::VARCHAR', 'p_brand')} SELECT case_id, expected_id, actual_id, similarity FROM found WHERE status = 'matched'")
def greedy_pairs(t: Tables) -> DataFrame:
    """One-to-one by likeness alone; every third key of 24 is matched with the others."""
    p = t.raw("part").select(F.floor(F.col("p_partkey") / 24).alias("case_id"), F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("rule_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("text"))
    third = F.col("id") % 3 == 0
    return E.golden_matching(p.where(third), p.where(~third)).where("status = 'matched'").select("case_id", "expected_id", "actual_id", F.round("similarity", 6).alias("similarity"))


@query("E02_similarity", f"WITH x AS (SELECT p_partkey, {_TOK.format('p_name')} AS a, {_TOK.format('p_type')} AS b, {_TOK.format('p_brand')} AS c FROM part) SELECT p_partkey, round(greatest({_J.format('a', 'b')}, 0.8 * {_J.format('a', 'c')}), 6) AS similarity FROM x")
def similarity(t: Tables) -> DataFrame:
    x = t.raw("part").select("p_partkey", E.tokens(F.col("p_name")).alias("a"), E.tokens(F.col("p_type")).alias("b"), E.tokens(F.col("p_brand")).alias("c"))
    return x.select("p_partkey", F.round(F.greatest(E.jaccard(F.col("a"), F.col("b")), 0.8 * E.jaccard(F.col("a"), F.col("c"))), 6).alias("similarity"))


@query("E03_recall_precision", f"WITH {_E01} SELECT case_id, round(count(CASE WHEN status = 'matched' AND expected_id % 10 = 0 THEN 1 END)::DOUBLE / nullif(count(CASE WHEN expected_id % 10 = 0 THEN 1 END), 0), 6) AS critical_recall, round(count(CASE WHEN status = 'matched' THEN 1 END)::DOUBLE / nullif(count(expected_id), 0), 6) AS overall_recall, round(count(CASE WHEN status = 'matched' THEN 1 END)::DOUBLE / nullif(count(actual_id), 0), 6) AS precision FROM found GROUP BY case_id")
def recall_precision(t: Tables) -> DataFrame:
    """Over the findings of the matching; every tenth key is a critical expectation."""
    expected, actual = findings(t)
    critical = expected.where("id % 10 = 0").select("case_id", F.col("id").alias("expected_id"))
    m = E.run_metrics(E.golden_matching(expected, actual), critical)
    return m.select("case_id", *[F.round(c, 6).alias(c) for c in ("critical_recall", "overall_recall", "precision")])


_PAIR = "SELECT p_partkey AS id, p_name AS pred, p_type AS gold FROM part"


def pairs(t: Tables) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("pred"), F.col("p_type").alias("gold"))


@query("E04_levenshtein", f"SELECT id, CAST(levenshtein(pred, gold) AS INTEGER) AS v FROM ({_PAIR})")
def levenshtein(t: Tables) -> DataFrame:
    return pairs(t).select("id", F.levenshtein("pred", "gold").alias("v"))


_CER = "CASE WHEN length(gold) = 0 THEN CASE WHEN length(pred) > 0 THEN 1.0 ELSE 0.0 END ELSE levenshtein(pred, gold)::DOUBLE / length(gold) END"


_PAGE = "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"


@query("E04b_page_distance", f"SELECT doc_id, length(gold) AS chars, CAST(levenshtein(pred, gold) AS INTEGER) AS distance, round(CASE WHEN length(gold) = 0 THEN CASE WHEN length(pred) > 0 THEN 1.0 ELSE 0.0 END ELSE levenshtein(pred, gold)::DOUBLE / length(gold) END, 6) AS cer FROM (SELECT doc_id, {_PAGE} AS gold, replace(replace({_PAGE}, 'the', 'teh'), '. ', '.') AS pred FROM documents)")
def page_distance(t: Tables) -> DataFrame:
    """Whole documents against themselves with misspellings, bit-parallel."""
    page = F.regexp_replace("text", "[^\\x00-\\x7F]", "?")
    docs = t.documents.select("doc_id", "text")
    if len(docs.inputFiles()) < t.spark.sparkContext.defaultParallelism:
        docs = spread(docs)
    x = docs.select("doc_id", page.alias("gold"), F.replace(F.replace(page, F.lit("the"), F.lit("teh")), F.lit(". "), F.lit(".")).alias("pred"))
    x = x.select("doc_id", F.length("gold").cast("long").alias("chars"), page_distances(F.col("pred"), F.col("gold")).alias("distance"), "pred")
    rate = F.when(F.col("chars") == 0, F.when(F.length("pred") > 0, 1.0).otherwise(0.0)).otherwise(F.col("distance") / F.col("chars"))
    return x.select("doc_id", "chars", "distance", F.round(rate, 6).alias("cer"))


@query("E05_cer", f"SELECT id, round({_CER}, 6) AS v FROM ({_PAIR})")
def cer(t: Tables) -> DataFrame:
    return pairs(t).select("id", F.round(E.cer(F.col("pred"), F.col("gold")), 6).alias("v"))


@query("E06_word_joined_cer", f"SELECT id, round({_CER}, 6) AS v FROM (SELECT id, trim(regexp_replace(lower(pred), '[ \\t]+', ' ', 'g')) AS pred, trim(regexp_replace(lower(gold), '[ \\t]+', ' ', 'g')) AS gold FROM ({_PAIR}))")
def word_joined_cer(t: Tables) -> DataFrame:
    join = lambda c: F.trim(F.regexp_replace(F.lower(c), "[ \\t]+", " "))
    return pairs(t).select("id", F.round(E.cer(join("pred"), join("gold")), 6).alias("v"))


@query("E07_overlap_f1", f"WITH x AS (SELECT id, list_distinct(list_filter(string_split(lower(pred), ' '), lambda w: w <> '')) AS p, list_distinct(list_filter(string_split(lower(gold), ' '), lambda w: w <> '')) AS g FROM ({_PAIR})) SELECT id, round(CASE WHEN len(g) = 0 THEN CASE WHEN len(p) = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) END, 6) AS v FROM x")
def overlap_f1(t: Tables) -> DataFrame:
    return pairs(t).select("id", F.round(E.overlap_f1(F.lower("pred"), F.lower("gold")), 6).alias("v"))


@query("E08_normalize_for_eval", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\.{3,}', '.', 'g'), ',{2,}', ',', 'g'), '-{3,}', '-', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS v FROM documents")
def normalize_for_eval(t: Tables) -> DataFrame:
    x = F.col("text")
    for pattern, to in (("\\.{3,}", "."), (",{2,}", ","), ("-{3,}", "-"), ("[ \\t\\n\\r]+", " ")):
        x = F.regexp_replace(x, pattern, to)
    return t.documents.select("doc_id", F.trim(x).alias("v"))


@query("E09_aggregate_metrics", f"SELECT count(*) AS n, round(avg({_CER}), 6) AS mean_cer, round(avg(CASE WHEN {_CER} > 0.8 THEN 1 ELSE 0 END) * 100, 4) AS routed FROM ({_PAIR})")
def aggregate_metrics(t: Tables) -> DataFrame:
    c = E.cer(F.col("pred"), F.col("gold"))
    return pairs(t).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean_cer"), F.round(F.avg((c > 0.8).cast("int")) * 100, 4).alias("routed"))


@query("E10_cer_gate", f"SELECT avg({_CER}) > 0.3 AS failed FROM ({_PAIR})")
def cer_gate(t: Tables) -> DataFrame:
    return pairs(t).agg((F.avg(E.cer(F.col("pred"), F.col("gold"))) > 0.3).alias("failed"))


@query("E11_confusion", "SELECT quality AS actual, toxic AS pred, count(*) AS n, quality = toxic AS right_ FROM labels GROUP BY 1, 2".replace("right_", "hit"))
def confusion(t: Tables) -> DataFrame:
    return t.raw("labels").groupBy(F.col("quality").alias("actual"), F.col("toxic").alias("pred")).agg(F.count("*").alias("n")).withColumn("hit", F.col("actual") == F.col("pred"))


@query("E12_misclassified", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic <> 1")
def misclassified(t: Tables) -> DataFrame:
    return t.raw("labels").where("quality = 1 AND toxic <> 1").select("doc_id")


_GOLD = "SELECT user_id, event_id, CASE WHEN action = 'error' THEN 'O' ELSE action END AS gold, CASE WHEN value < 20 THEN 'O' WHEN value > 80 THEN 'click' ELSE action END AS pred FROM audit"


@query("E13_sequence_f1", f"WITH s AS ({_GOLD}), l AS (SELECT DISTINCT gold AS label FROM s WHERE gold <> 'O'), c AS (SELECT label, (SELECT count(*) FROM s WHERE gold = label AND pred = label) AS tp, (SELECT count(*) FROM s WHERE pred = label) AS p, (SELECT count(*) FROM s WHERE gold = label) AS g FROM l) SELECT label, round(tp::DOUBLE / nullif(p, 0), 6) AS precision, round(tp::DOUBLE / nullif(g, 0), 6) AS recall, round(2.0 * tp / nullif(p + g, 0), 6) AS f1 FROM c")
def sequence_f1(t: Tables) -> DataFrame:
    s = t.audit.select(F.when(F.col("action") == "error", "O").otherwise(F.col("action")).alias("gold"), F.when(F.col("value") < 20, "O").when(F.col("value") > 80, "click").otherwise(F.col("action")).alias("pred"))
    long = s.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("pred")).cast("int").alias("tp")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    c = long.where("label <> 'O'").groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("tp").alias("tp")).where("g > 0")
    return c.select("label", F.round(F.try_divide("tp", "p"), 6).alias("precision"), F.round(F.try_divide("tp", "g"), 6).alias("recall"), F.round(F.try_divide(2.0 * F.col("tp"), F.col("p") + F.col("g")), 6).alias("f1"))


_BIO = "SELECT user_id, event_id, CASE WHEN action = 'error' THEN 'O' WHEN event_id % 3 = 0 THEN 'B-' || action ELSE 'I-' || action END AS gold, CASE WHEN value < 5 THEN 'O' WHEN value > 90 THEN 'B-click' WHEN action = 'error' THEN 'O' WHEN event_id % 3 = 0 OR event_id % 11 = 0 THEN 'B-' || action ELSE 'I-' || action END AS pred FROM audit"


@query("E13b_entity_f1", f"""WITH t AS ({_BIO}), l AS (SELECT user_id, event_id, 'gold' AS side, gold AS tag FROM t UNION ALL SELECT user_id, event_id, 'found', pred FROM t),
    x AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS label, starts_with(tag, 'B-') AS b FROM l),
    n AS (SELECT *, CASE WHEN b OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY user_id, side ORDER BY event_id) THEN 1 ELSE 0 END AS fresh FROM x),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, side ORDER BY event_id) AS run FROM n),
    e AS (SELECT user_id, side, label, min(event_id) AS a, max(event_id) AS z FROM r WHERE label IS NOT NULL GROUP BY user_id, side, run, label),
    s AS (SELECT user_id, label, a, z, count(*) FILTER (side = 'gold') AS g, count(*) FILTER (side = 'found') AS f FROM e GROUP BY ALL),
    c AS (SELECT label, sum(g) AS g, sum(f) AS f, sum(g * f) AS h FROM s GROUP BY ROLLUP (label))
    SELECT label, CAST(g AS BIGINT) AS gold, CAST(f AS BIGINT) AS found, CAST(h AS BIGINT) AS hit, round(h / nullif(f, 0), 6) AS precision, round(h / nullif(g, 0), 6) AS recall, round(2 * h / nullif(g + f, 0), 6) AS f1 FROM c""")
def entity_f1(t: Tables) -> DataFrame:
    """Whole entities of two taggings of users' events, orphaned I- tags repaired."""
    action, value, key = F.col("action"), F.col("value"), F.col("event_id")
    inside = F.concat(F.lit("I-"), action)
    gold = F.when(action == "error", "O").when(key % 3 == 0, F.concat(F.lit("B-"), action)).otherwise(inside)
    pred = F.when(value < 5, "O").when(value > 90, "B-click").when(action == "error", "O").when((key % 3 == 0) | (key % 11 == 0), F.concat(F.lit("B-"), action)).otherwise(inside)
    scores = E.entity_scores(t.audit.select("user_id", "event_id", gold.alias("gold"), pred.alias("pred")), "user_id", "event_id", "gold", "pred")
    return scores.select("label", "gold", "found", "hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("E14_best_similarity", f"WITH x AS (SELECT p_partkey // 40 AS case_id, p_partkey AS id, p_partkey % 2 = 0 AS gold, {_TOK.format('p_name')} AS a, {_TOK.format('p_type')} AS b FROM part) SELECT e.id AS expected_id, round(max(greatest({_J.format('e.a', 'o.a')}, 0.8 * {_J.format('e.b', 'o.b')})), 6) AS best FROM x e JOIN x o ON e.case_id = o.case_id AND e.gold AND NOT o.gold GROUP BY 1")
def best_similarity(t: Tables) -> DataFrame:
    expected, actual = findings(t)
    best = E.similarities(expected, actual).groupBy("expected_id").agg(F.max("similarity").alias("best"))
    met = expected.join(actual.select("case_id").distinct(), "case_id", "left_semi").select(F.col("id").alias("expected_id"))
    return met.join(best, "expected_id", "left").select("expected_id", F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"))


@query("U07_first_of_group", "SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def first_of_group(t: Tables) -> DataFrame:
    return W.first_by(t.raw("part"), ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey")
