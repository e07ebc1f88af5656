"""Aggregation operators over cases and what belongs to them.

Each table is read once: counts that differ by condition are conditional
aggregates of one pass, aggregated before they meet the cases.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def pct(part: Column, whole: Column, empty: float | None = 100.0, digits: int = 1) -> Column:
    """part / whole in per cent; `empty` where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(F.round(part * 100.0 / whole, digits))


def since(column: str, as_of: dt.date, days: int) -> Column:
    return F.col(column) >= F.lit(as_of - dt.timedelta(days=days))


def zero_filled(df: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
    """Counts of df by key for exactly these values: 0 where none, others dropped."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    counts = df.where(F.col(key).isin(values)).groupBy(key).agg(F.count("*").alias("_n"))
    return dim.join(counts, key, "left").select(key, F.coalesce("_n", F.lit(0)).alias(name))


def calendar(df: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """The dense days (as_of - days + 1 .. as_of)."""
    first = as_of - dt.timedelta(days=days - 1)
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(as_of))).alias("day"))


def daily(metrics: dict[str, tuple[DataFrame, str]], as_of: dt.date, days: int) -> DataFrame:
    """A zero-filled column of daily counts for each metric: one union, one aggregation, one calendar join."""
    first = as_of - dt.timedelta(days=days - 1)
    parts = [df.where(F.col(c).between(F.lit(first), F.lit(as_of))).select(F.col(c).alias("day"), F.lit(name).alias("metric")) for name, (df, c) in metrics.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    wide = long.groupBy("day").agg(*[n(F.col("metric") == name, name) for name in metrics])
    return calendar(long, as_of, days).join(wide, "day", "left").select(F.col("day").cast("string").alias("day"), *[F.coalesce(name, F.lit(0)).alias(name) for name in metrics])


def case_counts(exceptions: DataFrame, verifications: DataFrame) -> DataFrame:
    """Open exceptions by severity and pending verifications of each case, from one pass over each table."""
    e = exceptions.where("status = 'Open'").groupBy("case_id").agg(*[n(F.col("severity") == s, s.lower()) for s in ("High", "Medium", "Low")])
    v = verifications.where("status = 'Pending'").groupBy("case_id").agg(F.count("*").alias("pending"))
    return e.join(v, "case_id", "full").select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("high", "medium", "low", "pending")])


def counted_cases(cases: DataFrame, exceptions: DataFrame, verifications: DataFrame) -> DataFrame:
    counts = case_counts(exceptions, verifications)
    return cases.join(counts, "case_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("high", "medium", "low", "pending")})


def needs_attention(cases: DataFrame, exceptions: DataFrame, verifications: DataFrame, limit: int = 15) -> DataFrame:
    """The work queue: cases with open high exceptions or pending verifications, worst first."""
    return (
        counted_cases(cases, exceptions, verifications)
        .where("high > 0 OR pending > 0")
        .orderBy(F.desc("high"), F.desc("pending"), F.desc("updated"), F.asc("case_id"))
        .limit(limit)
    )


def cohort(
    cases: DataFrame,
    exceptions: DataFrame,
    verifications: DataFrame,
    *,
    status: str | None = None,
    severity: str | None = None,
    owner: str | None = None,
    user_id: int | None = None,
    updated_on: str | None = None,
    preset: str | None = None,
    as_of: dt.date | None = None,
    limit: int = 50,
) -> DataFrame:
    """Drill-down by any mix of filters; unknown owners and presets, and dates that don't parse, are ignored."""
    out = counted_cases(cases, exceptions, verifications)
    if status:
        out = out.where(F.col("status") == status)
    if severity and severity.lower() in ("high", "medium", "low"):
        out = out.where(F.col(severity.lower()) > 0)
    if owner == "mine":
        out = out.where(F.col("assigned_to") == user_id)
    elif owner == "unassigned":
        out = out.where(F.col("assigned_to").isNull())
    if updated_on:
        try:
            out = out.where(F.col("updated") == F.lit(dt.date.fromisoformat(updated_on)))
        except ValueError:
            pass
    if preset == "stale_unassigned" and as_of:
        out = out.where(F.col("assigned_to").isNull() & (F.col("updated") <= F.lit(as_of - dt.timedelta(days=3))) & ((F.col("high") > 0) | (F.col("pending") > 0)))
    return out.orderBy(F.desc("high"), F.desc("updated"), F.asc("case_id")).limit(limit)


def risk_scores(exceptions: DataFrame, hard_stops: list[str]) -> DataFrame:
    """10 High + 3 Medium + Low + 25 for each hard stop, over open and pending exceptions of each case."""
    stop = (F.col("severity") == "High") & F.exists(F.array(*[F.lit(h) for h in hard_stops]), lambda h: F.col("rule_id").contains(h))
    points = F.when(F.col("severity") == "High", 10).when(F.col("severity") == "Medium", 3).when(F.col("severity") == "Low", 1).otherwise(0) + F.when(stop, 25).otherwise(0)
    score = exceptions.where(F.col("status").isin("Open", "Pending")).groupBy("case_id").agg(F.sum(points).alias("score"), n(stop, "hard_stops"))
    return score.withColumn("label", F.when(F.col("score") == 0, "Green").when(F.col("score") < 25, "Amber").otherwise("Red"))


def decision_labels(exceptions: DataFrame, cps: DataFrame) -> DataFrame:
    """Review Required, Hold, Proceed with Conditions or Ready, by what is open."""
    e = exceptions.where("status = 'Open'").groupBy("case_id").agg(n(F.col("severity") == "Critical", "critical"), n(F.col("severity") == "High", "high"), n(F.col("severity").isin("Medium", "Low"), "rest"))
    c = cps.where("status = 'Open'").groupBy("case_id").agg(F.count("*").alias("open_cps"))
    z = {k: F.coalesce(k, F.lit(0)) for k in ("critical", "high", "rest", "open_cps")}
    out = e.join(c, "case_id", "full").withColumns(z)
    label = F.when((F.col("critical") >= 1) | (F.col("high") >= 2), "Review Required").when(F.col("high") >= 1, "Hold").when((F.col("open_cps") > 0) | (F.col("rest") > 0), "Proceed with Conditions").otherwise("Ready")
    return out.withColumn("decision", label)


def downgraded(level: Column) -> Column:
    return F.when(level == "good", "fair").when(level == "fair", "poor").otherwise("unusable")


def quality_level(score: Column) -> Column:
    return F.when(score.isNull(), "unavailable").when(score >= 0.7, "good").when(score >= 0.45, "fair").when(score >= 0.3, "poor").otherwise("unusable")


def document_quality(pages: DataFrame) -> DataFrame:
    """Mean page score as a level; down one for over 20 % failed pages, at most fair with a poor page, down one for many poor ones."""
    agg = pages.groupBy("doc_id").agg(F.avg("score").alias("mean"), F.count("*").alias("pages"), n(F.col("failed"), "failed"), n(F.col("level").isin("poor", "unusable"), "poor"))
    level = quality_level(F.col("mean"))
    level = F.when(F.col("failed") > 0.2 * F.col("pages"), downgraded(level)).otherwise(level)
    level = F.when((F.col("poor") > 0) & (level == "good"), "fair").otherwise(level)
    level = F.when(F.col("poor") > F.greatest(F.lit(1), F.floor(F.col("pages") / 2)), downgraded(level)).otherwise(level)
    return agg.withColumn("quality", level)
