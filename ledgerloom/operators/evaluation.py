"""Evaluation operators: golden matching, error rates, label metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SIMILARITY = 0.30


def tokens(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cer(pred: Column, gold: Column) -> Column:
    """Edit distance over code points by gold length; an empty gold counts 1 if anything was read."""
    return F.when(F.length(gold) == 0, F.when(F.length(pred) > 0, 1.0).otherwise(0.0)).otherwise(F.levenshtein(pred, gold) / F.length(gold))


def overlap_f1(pred: Column, gold: Column) -> Column:
    p, g = F.array_distinct(F.filter(F.split(pred, " "), lambda w: w != "")), F.array_distinct(F.filter(F.split(gold, " "), lambda w: w != ""))
    both = F.size(F.array_intersect(p, g))
    return F.when(F.size(g) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.try_divide(2.0 * both, F.size(p) + F.size(g)), F.lit(0.0)))


def similarities(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, expected_id, actual_id, similarity) of the pairs of a case that share a word: the greater of the titles' likeness and 0.8 of the texts'.

    Words meet by (case, part, word), so pairs without a common word, whose likeness is 0, are never formed.
    """

    def words(df: DataFrame, key: str, size: str) -> DataFrame:
        sets = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("w")) for i, c in enumerate(("title", "text"))])).alias("s")
        x = df.select("case_id", F.col("id").alias(key), sets).select("case_id", key, F.col("s.part").alias("part"), F.size("s.w").alias(size), F.explode("s.w").alias("word"))
        return x

    met = words(expected, "expected_id", "n_e").join(words(actual, "actual_id", "n_a"), ["case_id", "part", "word"]).groupBy("case_id", "expected_id", "actual_id", "part", "n_e", "n_a").agg(F.count("*").alias("both"))
    like = F.col("both") / (F.col("n_e") + F.col("n_a") - F.col("both"))
    return met.groupBy("case_id", "expected_id", "actual_id").agg(F.max(F.when(F.col("part") == 0, like).otherwise(0.8 * like)).alias("similarity"))


def golden_matching(expected: DataFrame, actual: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Greedy one-to-one matching within each case: (case_id, expected_id, actual_id, status, similarity).

    Expectations (case_id, id, rule_id, title, text) in the order of their ids
    take a free actual: the first of the same rule, else the most similar one of
    at least `least`, the first of equals.  A case's candidates are sorted once;
    the choice is a fold over its expectations, so only a case's own findings
    are in one row.  Cases with one side only give missed or extra findings.
    """
    same = expected.where("rule_id <> ''").select("case_id", "rule_id", F.col("id").alias("expected_id")).join(actual.select("case_id", "rule_id", F.col("id").alias("actual_id")), ["case_id", "rule_id"])
    pairs = same.select("case_id", "expected_id", "actual_id", F.lit(0).alias("tier"), F.lit(1.0).alias("similarity")).unionByName(similarities(expected, actual).where(F.col("similarity") >= least).withColumn("tier", F.lit(1)))
    best = pairs.groupBy("case_id", "expected_id").agg(F.array_sort(F.collect_list(F.struct("tier", F.when(F.col("tier") == 1, -F.col("similarity")).otherwise(0.0).alias("far"), F.col("actual_id").alias("a")))).alias("near"))
    ordered = best.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("expected_id", "near"))).alias("todo"))
    state = "struct<taken:array<bigint>,found:array<struct<e:bigint,a:bigint,s:double>>>"

    def choose(acc, x):
        free = F.try_element_at(F.filter(x["near"], lambda n: ~F.array_contains(acc["taken"], n["a"])), F.lit(1))
        one = F.array(F.struct(x["expected_id"].alias("e"), free["a"].alias("a"), F.when(free["tier"] == 0, 1.0).otherwise(-free["far"]).alias("s")))
        return F.when(free.isNull(), acc).otherwise(F.struct(F.concat(acc["taken"], F.array(free["a"])).alias("taken"), F.concat(acc["found"], one).alias("found")).cast(state))

    start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<struct<e:bigint,a:bigint,s:double>>").alias("found")).cast(state)
    matched = ordered.select("case_id", F.explode(F.aggregate("todo", start, choose)["found"]).alias("m")).select("case_id", F.col("m.e").alias("expected_id"), F.col("m.a").alias("actual_id"), F.col("m.s").alias("similarity"))
    side = lambda df, key: df.select("case_id", F.col("id").alias(key))
    left = side(expected, "expected_id").join(matched, ["case_id", "expected_id"], "left").select("case_id", "expected_id", "actual_id", F.when(F.col("actual_id").isNull(), "missed").otherwise("matched").alias("status"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    extra = side(actual, "actual_id").join(matched.select("case_id", "actual_id"), ["case_id", "actual_id"], "left_anti").select("case_id", F.lit(None).cast("long").alias("expected_id"), "actual_id", F.lit("extra").alias("status"), F.lit(0.0).alias("similarity"))
    return left.unionByName(extra)


def run_metrics(findings: DataFrame, critical: DataFrame) -> DataFrame:
    """(case_id, critical_recall, overall_recall, precision) of findings; critical: (case_id, expected_id) of the critical expectations. NULL where nothing is counted."""
    f = findings.join(critical.select("case_id", "expected_id", F.lit(True).alias("critical")), ["case_id", "expected_id"], "left")
    matched, wanted, crit = F.col("status") == "matched", F.col("status") != "extra", F.coalesce("critical", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    return f.groupBy("case_id").agg(
        F.try_divide(n(matched & crit), n(wanted & crit)).alias("critical_recall"), F.try_divide(n(matched), n(wanted)).alias("overall_recall"), F.try_divide(n(matched), n(F.col("status") != "missed")).alias("precision")
    )


def entities(tags: DataFrame, keys: list[str], order: str, tag: str) -> DataFrame:
    """(keys, label, first, last) of each entity of B-, I- and O tags in order.

    An entity begins at a B-, and at an I- that continues none: after an O or
    another label (orphans are repaired, not lost).  A null tag is an O.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    label, kind = F.nullif(F.substring(tag, 3, 1 << 20), F.lit("")), F.substring(tag, 1, 2)
    x = tags.select(*keys, order, F.when(kind.isin("B-", "I-"), label).alias("label"), F.coalesce(kind == "B-", F.lit(False)).alias("_b"))
    x = x.withColumn("_new", F.when(F.col("_b") | ~F.col("label").eqNullSafe(F.lag("label").over(w)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return x.where("label IS NOT NULL").groupBy(*keys, "_run", "label").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_run")


def entity_scores(tags: DataFrame, key: str, order: str, gold: str, pred: str) -> DataFrame:
    """(label, gold, found, hit, precision, recall, f1) by label and, as label null, over all.

    An entity is a hit if label, first and last token agree.  Both sides go
    through one pass, side by side, and meet by their spans in an aggregate.
    """
    side = lambda name, c: F.struct(F.lit(name).alias("_side"), F.col(c).alias("_tag"))
    long = tags.select(key, order, F.explode(F.array(side("gold", gold), side("found", pred))).alias("_s")).select(key, order, "_s.*")
    has = lambda name: F.max((F.col("_side") == name).cast("int")).alias(name)
    spans = entities(long, [key, "_side"], order, "_tag").groupBy(key, "label", "first", "last").agg(has("gold"), has("found"))
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    n = spans.rollup("label").agg(count(F.col("gold"), "gold"), count(F.col("found"), "found"), count(F.col("gold") * F.col("found"), "hit"))
    return n.select("label", "gold", "found", "hit", F.try_divide("hit", "found").alias("precision"), F.try_divide("hit", "gold").alias("recall"), F.try_divide(2 * F.col("hit"), F.col("gold") + F.col("found")).alias("f1"))
