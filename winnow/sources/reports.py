"""Scanner reports (one JSON text per scan) to one normalized findings schema.

Input frames carry ``scan_id, source, report``.  A format is a Column expression
from a report to an array of findings; all formats are exploded in one pass
without a shuffle, and Spark splits the work by report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions import scoring
from winnow.functions.common import reasons, text
from winnow.settings import DEFAULTS, Settings

NORMALIZED = ["scan_id", "rule_id", "cwe_id", "file_path", "line_number", "severity", "message", "snippet"]

SARIF_SCHEMA = """
runs array<struct<
  tool: struct<driver: struct<rules: array<struct<id: string, properties: struct<tags: array<string>>>>>>,
  results: array<struct<
    ruleId: string, level: string, message: struct<text: string>,
    properties: struct<severity: string, cweId: string>,
    locations: array<struct<physicalLocation: struct<
      artifactLocation: struct<uri: string>,
      region: struct<startLine: int, snippet: struct<text: string>>>>>>>>>
"""
SONAR_SCHEMA = "issues array<struct<rule: string, component: string, line: int, severity: string, message: string>>"
BANDIT_SCHEMA = """
results array<struct<test_id: string, issue_cwe: struct<id: int>, filename: string, line_number: int,
  issue_severity: string, issue_text: string, code: string>>
"""
PHPCS_SCHEMA = """
files map<string, struct<messages: array<struct<source: string, line: int, type: string, message: string>>>>
"""


def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def _finding(rule, cwe, path, line, severity, message, snippet) -> Column:
    return F.struct(
        _or(rule, "unknown").alias("rule_id"),
        cwe.cast("int").alias("cwe_id"),
        _or(path, "unknown").alias("file_path"),
        _or(line, 1).cast("int").alias("line_number"),
        severity.alias("severity"),
        _or(message, "").alias("message"),
        snippet.cast("string").alias("snippet"),
    )


def normalized(df: DataFrame, rule, cwe, path, line, severity, message, snippet) -> DataFrame:
    """The normalized columns of one finding a row, with their defaults: what an added reader returns."""
    return df.select("scan_id", _finding(rule, cwe, path, line, severity, message, snippet).alias("_f")).select("scan_id", "_f.*")


def _each(groups: Column, items: Callable[[Column], Column], finding: Callable[[Column, Column], Column]) -> Column:
    """Findings of all items of all groups, in order; groups without items give none."""
    some = F.filter(groups, lambda g: items(g).isNotNull())
    return F.flatten(F.transform(some, lambda g: F.transform(items(g), lambda i: finding(g, i))))


def sarif_rows(report: Column) -> Column:
    """Findings of one report; a result looks its rule up in its own run, whose rules are not copied."""

    def place(r: Column) -> Column:
        return F.try_element_at(r["locations"], F.lit(1))["physicalLocation"]

    def finding(run: Column, r: Column) -> Column:
        rule_id = _or(r["ruleId"], "unknown")
        # the last rule of a duplicated id wins
        metas = F.filter(run["tool"]["driver"]["rules"], lambda m: m["id"] == rule_id)
        tags = F.try_element_at(metas, F.lit(-1))["properties"]["tags"]
        return _finding(
            r["ruleId"],
            F.coalesce(scoring.tag_cwe(tags), r["properties"]["cweId"].try_cast("double").try_cast("int")),
            place(r)["artifactLocation"]["uri"],
            place(r)["region"]["startLine"],
            scoring.sarif_severity(r["properties"]["severity"], r["level"]),
            r["message"]["text"],
            place(r)["region"]["snippet"]["text"],
        )

    return _each(F.from_json(report, SARIF_SCHEMA)["runs"], lambda run: F.filter(run["results"], lambda r: place(r).isNotNull()), finding)


def semgrep_rows(report: Column) -> Column:
    """``metadata.cwe`` is a text or a list of texts, so results stay VARIANT."""

    def finding(v: Column) -> Column:
        def get(path, kind="string"):
            return F.try_variant_get(v, path, kind)

        cwe = F.coalesce(get("$.extra.metadata.cwe[0]"), get("$.extra.metadata.cwe"))
        return _finding(
            get("$.check_id"), scoring.text_cwe(cwe), get("$.path"), get("$.start.line", "int"),
            F.upper(_or(get("$.extra.severity"), "MEDIUM")), get("$.extra.message"), get("$.extra.lines"),
        )

    return F.transform(F.try_variant_get(F.try_parse_json(report), "$.results", "array<variant>"), finding)


def sonarqube_rows(report: Column) -> Column:
    none = F.lit(None)
    return F.transform(F.from_json(report, SONAR_SCHEMA)["issues"], lambda i: _finding(
        i["rule"], none, F.regexp_replace(_or(i["component"], "unknown"), r"^[^:]+:", ""),
        i["line"], F.upper(_or(i["severity"], "MEDIUM")), i["message"], none,
    ))


def bandit_rows(report: Column) -> Column:
    def finding(r: Column) -> Column:
        declared = F.upper(_or(r["issue_severity"], "MEDIUM"))
        return _finding(
            r["test_id"], r["issue_cwe"]["id"], r["filename"], r["line_number"],
            F.when(declared.isin("LOW", "MEDIUM", "HIGH"), declared).otherwise("MEDIUM"),
            r["issue_text"], r["code"],
        )

    return F.transform(F.from_json(report, BANDIT_SCHEMA)["results"], finding)


def phpcs_rows(report: Column) -> Column:
    none = F.lit(None)
    files = F.map_entries(F.from_json(report, PHPCS_SCHEMA)["files"])
    return _each(files, lambda f: f["value"]["messages"], lambda f, m: _finding(
        m["source"], none, f["key"], m["line"],
        F.when(m["type"] == "ERROR", "HIGH").otherwise("MEDIUM"), m["message"], none,
    ))


#: the findings of one report as an array, per scanner
ROWS: dict[str, Callable[[Column], Column]] = {
    "sarif": sarif_rows,
    "semgrep": semgrep_rows,
    "sonarqube": sonarqube_rows,
    "bandit": bandit_rows,
    "phpcs": phpcs_rows,
}


def _exploded(reports: DataFrame, rows: Column, *keep: str) -> DataFrame:
    """One row per finding, ``ordinal`` its place in the report."""
    return reports.select(*keep, F.posexplode(rows).alias("ordinal", "_f")).select(*keep, "_f.*", "ordinal")


def _reader(rows: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda reports: _exploded(reports, rows(F.col("report")), "scan_id").select(NORMALIZED)


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {name: _reader(rows) for name, rows in ROWS.items()}
BUILT_IN = dict(READERS)
read_sarif = READERS["sarif"]


def register_reader(source: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    """Add a scanner: a function from (scan_id, report) to the normalized columns."""
    READERS[source] = reader


def split_malformed(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report that is not JSON fails its own scan and no other."""
    parsed = F.try_parse_json("report").isNotNull()
    return reports.filter(parsed), reports.filter(~parsed)


def split_supported(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = F.coalesce(F.col("source").isin(list(READERS)), F.lit(False))
    return reports.filter(known), reports.filter(~known)


def with_documents(reports: DataFrame) -> DataFrame:
    """Adds ``document``, the digest of the report: with the scan, the key under which it is ingested once."""
    return reports.withColumn("document", F.sha2("report", 256))


def normalize_reports(reports: DataFrame) -> DataFrame:
    """Findings of all reports; malformed or unsupported ones give no rows.

    The built-in formats are read in one pass: each report is turned into an array of findings by the
    expression of its own format.  Added readers read their own reports after that.

    Where reports carry their ``document``, so do the rows, with project and commit as far as the reports
    have them, and ``ordinal``, a finding's place in its document (null from added readers, which hand on
    ``scan_id`` as it is, with all that in it).
    """
    ok, _ = split_malformed(split_supported(reports)[0])
    carried = [c for c in ("document", "project_id", "commit_sha") if c in reports.columns] if "document" in reports.columns else []
    shown = ["scan_id", "source", *NORMALIZED[1:], *carried, *(["ordinal"] if carried else [])]
    one_pass = [n for n, reader in READERS.items() if reader is BUILT_IN.get(n)]
    rows = F.coalesce(*[F.when(F.col("source") == n, ROWS[n](F.col("report"))) for n in one_pass]) if one_pass else None
    out = None if rows is None else _exploded(ok.filter(F.col("source").isin(one_pass)), rows, "scan_id", "source", *carried).select(shown)
    if carried:
        ok = ok.withColumn("scan_id", F.struct("scan_id", *carried))
    for source, reader in READERS.items():
        if source in one_pass:
            continue
        part = reader(ok.filter(F.col("source") == source)).withColumn("source", F.lit(source))
        if carried:
            part = part.withColumns({c: F.col(f"scan_id.{c}") for c in (*carried, "scan_id")} | {"ordinal": F.lit(None).cast("int")})
        out = part.select(shown) if out is None else out.unionByName(part.select(shown))
    return out


def arrival_reasons(s: Settings = DEFAULTS) -> Column:
    return reasons(
        (F.col("project_id").isNull(), "project_missing"),
        (~F.coalesce(F.col("source").isin([*fv.SCAN_SOURCES, *READERS]), F.lit(False)), "source_unsupported"),
        (~text("commit_sha").rlike(r"^[0-9a-fA-F]{40}$"), "commit_malformed"),
        ((F.length(text("branch")) == 0) | (F.length(text("branch")) > 255), "branch_length"),
        (F.coalesce(F.col("size_bytes"), F.lit(0)) > s.max_report_bytes, "report_too_large"),
    )


def validate_arrivals(arrivals: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds ``reject_reasons`` (empty when accepted) and lower-cases the commit."""
    return arrivals.withColumn("reject_reasons", arrival_reasons(s)).withColumn("commit_sha", F.lower("commit_sha"))
