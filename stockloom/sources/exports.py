"""Report sinks. Files are written by the tasks, so a report may have any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def export_csv(report: DataFrame, path: str) -> None:
    """A folder of CSV files with headers."""
    report.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """An exported report again, with the column types of ``like``."""
    return spark.read.schema(like.schema).csv(path, header=True)


def export_report(sheets: dict[str, DataFrame], path: str, fmt: str = "csv") -> dict[str, str]:
    """A workbook as a folder with one sub-folder per sheet; returns the folder of each sheet."""
    folders = {}
    for name, sheet in sheets.items():
        folders[name] = f"{path}/{name.lower().replace(' ', '_')}"
        writer = sheet.write.mode("overwrite")
        writer.csv(folders[name], header=True) if fmt == "csv" else writer.format(fmt).save(folders[name])
    return folders
