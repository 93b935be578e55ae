"""The library's entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weightscope.plans import compare as _compare
from weightscope.plans import report as _report
from weightscope.plans import scan as _scan
from weightscope.plans.compare import Comparison
from weightscope.plans.report import Report
from weightscope.plans.scan import Scan


def scan_tables(spark: SparkSession, path: str, **options) -> Scan:
    """The tables of a scan, for more queries. Options as for ``plans.scan.run``."""
    return _scan.run(spark, path, **options)


def scan(spark: SparkSession, path: str, **options) -> Report:
    """Scan a file or a folder and report."""
    return _report.collect(_scan.run(spark, path, **options))


def scan_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """Scan and report as a table of JSON texts, one an artifact, that executors make."""
    return _report.documents(_scan.run(spark, path, **options))


def verify(spark: SparkSession, path: str, bundle: str | None = None, key: str | None = None, **options) -> Report:
    """Scan with a signature file and a public key for every artifact."""
    return scan(spark, path, bundle=bundle, key=key, **options)


def compare(spark: SparkSession, subject: str, baseline: str, **options) -> Comparison:
    """Compare two models. Options as for ``plans.compare.run``."""
    return _compare.run(spark, subject, baseline, **options)
