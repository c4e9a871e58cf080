"""Sinks: result summaries and detailed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sink_csv(summary: DataFrame, path: str, overwrite: bool = False) -> None:
    """Append summary rows, or replace what is there; every file has a header."""
    summary.write.mode("overwrite" if overwrite else "append").option("header", True).csv(path)


def sink_detail(rows: DataFrame, path: str, **columns: Column) -> None:
    """Detailed rows with further columns, as Parquet (splittable, and safe to read)."""
    rows.withColumns(columns).write.mode("append").parquet(path)


def fmt_percent(c: Column) -> Column:
    """Percent with two decimals; N/A for null."""
    return F.when(c.isNotNull(), F.format_string("%.2f", c * 100)).otherwise("N/A")


def fmt_decimals(c: Column) -> Column:
    """Four decimals; N/A for null."""
    return F.when(c.isNotNull(), F.format_string("%.4f", c)).otherwise("N/A")
