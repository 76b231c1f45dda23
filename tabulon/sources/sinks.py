"""Sinks: tables as CSV or Parquet folders, reports as JSON."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions.values import INDEX


def stamp() -> str:
    return datetime.now().strftime("%Y%m%d_%H%M%S")


def export_table(df: DataFrame, folder: str, name: str, format: str = "csv", single: bool = False, bom: bool = False) -> str | None:
    """Written below ``folder`` under a name with the time; in the order of the index where there is one; nothing for an empty table. ``single``
    makes one file of it: for small tables. ``bom``: CSV files start with the mark by which spreadsheets know UTF-8."""
    if df.isEmpty():
        return None
    df = df.orderBy(INDEX) if INDEX in df.columns else df
    path = f"{folder.rstrip('/')}/{name}_{stamp()}"
    if bom and format == "csv" and df.columns:  # every file has its own header, whose first byte it is
        df = df.toDF(f"\ufeff{df.columns[0]}", *df.columns[1:])
    out = (df.coalesce(1) if single else df).write
    out.csv(path, header=True) if format == "csv" else out.format(format).save(path)
    return path


def export_report(report: dict, folder: str, name: str) -> str:
    path = Path(folder) / f"{name}_{stamp()}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return str(path)
