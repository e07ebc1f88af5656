"""Upserts, updates and deletes of a partitioned Parquet table, by rewriting the partitions they touch.

A table is a folder with one subfolder for each value of `part`, by default a
hash of its key.  A change finds the partitions that hold its keys, reads
those alone (partition pruning), writes what they become to a staging folder,
and puts it in their place by a dynamic partition overwrite; other partitions'
files aren't opened.  A partition that loses all rows is removed.  Until the
overwrite commits, readers see the old files; a run that dies before can be
repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W
from ..session import shared_folder

PART = "part"


def bucket(key: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias(PART)


def create(df: DataFrame, path: str, key: list[str], parts: int = 16) -> None:
    df.select("*", bucket(key, parts)).repartition(PART).write.partitionBy(PART).parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows; schema: of its own columns."""
    return spark.read.schema(f"{schema}, {PART} int").parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def rewrite(spark: SparkSession, path: str, schema: str, touched: DataFrame, become: Callable[[DataFrame], DataFrame]) -> list[int]:
    """The partitions listed in touched (part) become become(rows); returns them.

    The list is as long as the table has partitions at most.
    """
    parts = sorted(r[0] for r in touched.select(PART).distinct().collect())
    if not parts:
        return []
    staged = shared_folder(spark, "staged")
    become(read(spark, path, schema).where(F.col(PART).isin(parts))).repartition(PART).write.partitionBy(PART).parquet(staged)
    made = read(spark, staged, schema)
    left = {r[0] for r in made.select(PART).distinct().collect()}
    made.repartition(PART).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(PART).parquet(path)
    for p in set(parts) - left:
        gone, fs = _path(spark, f"{path}/{PART}={p}")
        fs.delete(gone, True)
    for folder in (staged,):
        gone, fs = _path(spark, folder)
        fs.delete(gone, True)
    return parts


def upsert(spark: SparkSession, path: str, schema: str, changes: DataFrame, key: list[str], parts: int = 16) -> list[int]:
    """Rows of changes replace those of their key or are added; changes has one row for a key."""
    dealt = changes.select("*", bucket(key, parts))
    return rewrite(spark, path, schema, dealt, lambda old: W.upsert(old, dealt.select(*old.columns), key))


def update(spark: SparkSession, path: str, schema: str, where: Column, values: dict[str, Column]) -> list[int]:
    """Sets columns, none of them of the key, in the rows where the condition holds."""
    rows = read(spark, path, schema)
    return rewrite(spark, path, schema, rows.where(where), lambda old: old.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}))


def delete(spark: SparkSession, path: str, schema: str, keys: DataFrame, on: list[str]) -> list[int]:
    """Removes the rows whose `on` columns are among keys."""
    gone = keys.select(*on).distinct()
    hit = read(spark, path, schema).join(gone, on, "left_semi")
    return rewrite(spark, path, schema, hit, lambda old: old.join(gone, on, "left_anti").select(*old.columns))
