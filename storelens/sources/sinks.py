"""Report and lead files (SNK-01, 03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def report_rows(rows: DataFrame, report_id: str, period: str) -> DataFrame:
    """SNK-01: evidence rows keyed by report and period."""
    return rows.withColumn("report_id", F.lit(report_id)).withColumn("period", F.lit(period))


def write_report(rows: DataFrame, path: str, report_id: str, period: str) -> None:
    """SNK-01: stores a report's rows; only the partitions of its own period and id are replaced."""
    (report_rows(rows, report_id, period).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period", "report_id").parquet(path))


def write_leads_csv(leads: DataFrame, path: str) -> None:
    """SNK-03: the lead report as quoted CSV; the header starts with a byte-order mark for spreadsheet programs."""
    first, *rest = leads.columns
    leads.toDF("﻿" + first, *rest).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
