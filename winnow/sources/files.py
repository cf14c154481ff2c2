"""File sources: report drops, expected-results CSV and source trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions.common import col
from winnow.settings import DEFAULTS, Settings

EXPECTED_SCHEMA = "test_name string, category string, vulnerable boolean, cwe int"


def read_expected_results(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark ground truth as trusted labels."""
    raw = spark.read.csv(path, header=True, schema=EXPECTED_SCHEMA)
    return raw.select(
        "test_name", "category", F.col("cwe").alias("cwe_id"),
        F.when(F.col("vulnerable"), "true_positive").otherwise("false_positive").alias("corrected_label"),
        F.lit("benchmark").alias("source"),
        F.lit(True).alias("training_eligible"),
    )


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole report files with their size, one row per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("value").alias("report"),
    )


def excluded_path(path, excludes=None) -> Column:
    """True when any folder of the path is on the exclude list."""
    names = [e.lower() for e in (excludes or fv.EXCLUDED_DIRECTORIES)]
    parts = F.split(F.lower(F.replace(col(path), F.lit("\\"), F.lit("/"))), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))


def source_file_status(path, size_bytes, s: Settings = DEFAULTS, excludes=None, extension="php") -> Column:
    """scanned, excluded, other (extension) or skipped (over a limit the settings give)."""
    return (
        F.when(excluded_path(path, excludes), "excluded")
        .when(~F.lower(col(path)).endswith("." + extension), "other")
        .when((col(size_bytes) > s.max_file_bytes) & F.lit(s.max_file_bytes > 0), "skipped")
        .otherwise("scanned")
    )


def list_source_files(spark: SparkSession, root: str, s: Settings = DEFAULTS, excludes=None) -> DataFrame:
    """Every file below ``root`` with its scan status; contents are not read."""
    base = root.rstrip("/")
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(
        F.regexp_replace("path", "^.*?" + base.replace(".", r"\.") + "/", "").alias("path"),
        F.col("length").alias("size_bytes"),
    )
    return meta.withColumn("status", source_file_status("path", "size_bytes", s, excludes))


def read_source_lines(spark: SparkSession, root: str, s: Settings = DEFAULTS, excludes=None) -> DataFrame:
    """(file_path, line_no, text) of every scanned file."""
    base = root.rstrip("/")
    files = spark.read.text(base, wholetext=True, recursiveFileLookup=True).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + base.replace(".", r"\.") + "/", "").alias("file_path"),
        F.col("_metadata.file_size").alias("size_bytes"),
        "value",
    )
    kept = files.filter(source_file_status("file_path", "size_bytes", s, excludes) == "scanned")
    return explode_lines(kept.select("file_path", F.col("value").alias("text")))


def explode_lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line, numbered from 1; the other columns are repeated."""
    keep = [c for c in files.columns if c != text_col]
    return files.select(*keep, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "text")).select(
        *keep, (F.col("pos") + 1).alias("line_no"), "text"
    )
