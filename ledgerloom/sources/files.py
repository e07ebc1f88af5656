"""File sources and sinks with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "filename string, actual_type string, text string"
MANIFEST = "items array<struct<id:string,pages:array<struct<page:int,gt_path:string>>>>"


def csv_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=LABELS, multiLine=True, escape='"')


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of every .txt file of a folder: the sidecars of scanned files."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select(F.regexp_extract("path", "([^/]+)\\.txt$", 1).alias("name"), "text")


def folder_labels(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """The labelling sheet of a folder tree: a row for each file, with the text of the .txt file beside it, if there is one."""
    stem = F.regexp_replace("_metadata.file_path", "\\.[^./]*$", "").alias("stem")
    scans = spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup="true").load(path).select(stem, F.regexp_extract("path", "([^/]+)$", 1).alias("filename"))
    beside = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select(stem, F.col("value").alias("text"))
    return scans.join(beside, "stem", "left").select("filename", F.lit("").alias("actual_type"), F.coalesce("text", F.lit("")).alias("text"))


def manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, page, gt_path) of JSON manifests of items with pages: a file each, or one to a line."""
    m = spark.read.json(path, schema=MANIFEST, multiLine=not lines).select(F.explode("items").alias("i"))
    return m.select("i.id", F.explode("i.pages").alias("p")).select("id", "p.page", "p.gt_path")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema).dropna("all")


def paged(df: DataFrame, text: str, mark: str = "\f") -> DataFrame:
    """One row for each page of a text with page marks, numbered from 1."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.split(text, mark)).alias("page", "page_text")).withColumn("page", F.col("page") + 1)


def to_csv(df: DataFrame, path: str, limit: int = 500) -> None:
    """At most `limit` rows as one CSV file with a header: a report, not an export of a table."""
    df.limit(limit).coalesce(1).write.csv(path, header=True, mode="overwrite", timestampFormat="yyyy-MM-dd'T'HH:mm:ss")


def to_report(df: DataFrame, path: str) -> str:
    """Metric rows as JSON files, and as a Markdown table for people (a few rows)."""
    df.write.json(path, mode="overwrite")
    rows = df.limit(1000).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])


def append(df: DataFrame, path: str) -> None:
    """Audit rows are only ever added."""
    df.write.mode("append").parquet(path)
