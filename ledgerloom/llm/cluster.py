"""What the operators need of the cluster: shared storage and partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: spark.checkpoint.dir, or a folder of our own where it is unset and all runs on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


@contextmanager
def _shuffles_end_with_the_job(spark: SparkSession) -> Iterator[None]:
    """A table that is written is read again from its files, so the shuffles that made it can go at once."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, keep: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors and is compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_the_job(spark):
        df.write.option("compression", keep or "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As written(), dealt once to n buckets by key: grouping and joins by key then need no exchange of it."""
    spark = df.sparkSession
    title = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    with _shuffles_end_with_the_job(spark):
        df.repartition(n, key).write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{title}").bucketBy(n, key).format("parquet").saveAsTable(title)
    return spark.table(title)


def forget(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing will read it again."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
