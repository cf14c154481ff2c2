"""Registry of named queries: a Spark function over (spark, sf_dir) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.tables import with_tables
from winnow.session import tune
from winnow.sources import testdata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazily built adapter tables of one data folder; plans are built once per session, never their data."""

    _plans: dict = {}
    _derived_from_findings = {"feedback", "contexts", "assessments"}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def _build(self, name: str) -> DataFrame:
        if name.startswith("raw_"):
            return testdata.table(self.spark, self.sf_dir, name[4:])
        if name == "runs":
            from catalog.derived import review_runs

            return review_runs(self)
        if name in self._derived_from_findings:
            return getattr(testdata, name)(self.spark, self.sf_dir, self.findings)
        if name == "assessment_feedback":
            return testdata.assessment_feedback(self.spark, self.sf_dir, self.assessments)
        return getattr(testdata, name)(self.spark, self.sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, id(self.spark), self.sf_dir, name)
        if key not in self._plans:
            self._plans[key] = self._build(name)
        return self._plans[key]


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``fn(t: Tables)``; ``tables`` are the adapter tables the SQL mentions."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(*tables, body=sql) if tables else sql.strip()
        return fn

    return wrap
