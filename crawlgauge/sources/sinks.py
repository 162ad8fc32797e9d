"""Sinks for audit results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(nested: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Nested results, one record per scan, as Parquet, ORC or JSON lines."""
    nested.write.mode(mode).format(fmt).save(path)


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text reports with the file name each is to be served under.

    Stored as rows: one file per site would be millions of small files.
    """
    reports.select("scan_id", "file_name", "report").write.mode(mode).parquet(path)
