"""Writers: fresh export folders, ordered JSON and CSV parts, hashes read back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import scoring
from winnow.operators import detect
from winnow.session import scratch

ROWS_PER_FILE = 200_000


def relative_output(name: str) -> str:
    """A relative folder without traversal, or an error."""
    clean = name.strip().replace("\\", "/")
    absolute = re.match(r"^(?:/|[A-Za-z]:/|//)", clean)
    if clean == "" or "\0" in clean or absolute or any(p in (".", "..") for p in clean.split("/")):
        raise ValueError("output must be a relative folder without traversal segments")
    return clean.rstrip("/")


def write_jsonl(df: DataFrame, path: str, order=None, compression: str = "none") -> None:
    """JSON lines in range-partitioned global order; refuses an existing folder."""
    out = df.orderBy(*order) if order else df
    out.write.mode("errorifexists").option("ignoreNullFields", "false").option("maxRecordsPerFile", ROWS_PER_FILE).option(
        "compression", compression).json(path)


def write_csv(df: DataFrame, path: str, order=None, compression: str = "none") -> None:
    out = df.orderBy(*order) if order else df
    out.write.mode("errorifexists").option("escape", '"').option("maxRecordsPerFile", ROWS_PER_FILE).option(
        "compression", compression).csv(path, header=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, for results that several outputs use."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def read_of(staged: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` as a reader of staged rows, by which they may be dropped."""
    df._staged_at = getattr(staged, "_staged_at", None)
    return df


def drop_staged(*frames: DataFrame) -> None:
    """Give back the space of staged rows that nobody reads any more."""
    for df in (x for x in frames if x._staged_at):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the data files below a written folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def output_entry(spark: SparkSession, path: str, records: int) -> dict:
    """Manifest entry of one output: its parts are few, each up to ROWS_PER_FILE rows."""
    parts = file_hashes(spark, path).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ":"), 256).alias("sha256"),
        F.count(F.lit(1)).alias("parts"),
    ).first()
    return {"path": path, "records": records, "bytes": parts["bytes"], "parts": parts["parts"], "sha256": parts["sha256"]}


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


# ---- shared findings --------------------------------------------------------
def strip_snippets(f: DataFrame) -> DataFrame:
    """Source text does not leave the boundary."""
    name = "snippet" if "snippet" in f.columns else "raw_snippet"
    return f.withColumn(name, F.lit(None).cast("string"))


def to_findings_json(f: DataFrame) -> DataFrame:
    """Flat findings with the field names of the command-line report."""
    snippet = "snippet" if "snippet" in f.columns else "raw_snippet"
    return f.select(
        F.col("rule_id").alias("ruleId"), F.col("cwe_id").alias("cweId"), "severity",
        F.col("file_path").alias("file"), F.col("line_number").alias("line"), "message",
        F.col(snippet).alias("snippet"),
    )


def to_sarif(f: DataFrame, rules: DataFrame | None = None, per_document: int = 5000) -> DataFrame:
    """SARIF documents: (scan_id, part, report).

    A scan with many findings becomes several documents of about ``per_document``
    results, so no task ever holds a whole large scan.  ``rules`` (external_id,
    cwe_id, description) default to the built-in detection rules.
    """
    snippet = F.col("snippet" if "snippet" in f.columns else "raw_snippet")
    key = F.xxhash64(*[c for c in ("id", "rule_id", "file_path", "line_number", "message") if c in f.columns])
    sizes = f.groupBy("scan_id").agg(F.ceil(F.count(F.lit(1)) / per_document).alias("_parts"))
    rows = f.join(sizes, "scan_id").withColumn("part", F.pmod(key, F.col("_parts")).cast("int"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        scoring.sarif_level("severity").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line_number").alias("startLine"),
                     F.when(snippet.isNotNull(), F.struct(snippet.alias("text"))).alias("snippet")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"),
        F.struct(F.upper("severity").alias("severity"), F.col("cwe_id").alias("cweId")).alias("properties"),
    )
    described = F.lit(None)
    if rules is None:
        described = F.array(*[
            F.struct(
                F.lit(r.id).alias("id"), F.struct(F.lit(r.description).alias("text")).alias("shortDescription"),
                F.struct(scoring.sarif_level(F.lit(r.severity)).alias("level")).alias("defaultConfiguration"),
                F.struct(F.array(F.lit("security"), *([F.lit(f"CWE-{r.cwe}")] if r.cwe else [])).alias("tags")).alias("properties"),
            )
            for r in detect.RULES.values()
        ])
        documents = rows.groupBy("scan_id", "part").agg(F.collect_list(result).alias("results")).withColumn("_rules", described)
    else:
        meta = rules.select(
            F.col("external_id").alias("rule_id"),
            F.struct(
                F.col("external_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"),
                F.struct(F.array_compact(F.array(F.lit("security"), F.concat(F.lit("CWE-"), F.col("cwe_id").cast("string")))).alias("tags")).alias("properties"),
            ).alias("_meta"),
        )
        documents = rows.join(meta, "rule_id", "left").groupBy("scan_id", "part").agg(
            F.collect_list(result).alias("results"), F.array_sort(F.collect_set("_meta")).alias("_rules"))
    run = F.struct(
        F.struct(F.struct(F.lit("winnow").alias("name"), F.col("_rules").alias("rules")).alias("driver")).alias("tool"),
        F.col("results"),
    )
    report = F.to_json(F.struct(
        F.lit("2.1.0").alias("version"),
        F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"),
        F.array(run).alias("runs"),
    ))
    return documents.select("scan_id", "part", report.alias("report"))
