"""Sinks: result tables as CSV, JSON or parquet, and records with dates as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def records(df: DataFrame) -> DataFrame:
    """The same rows with every timestamp as text."""
    return df.select(
        *[
            F.date_format(f.name, DATE_FORMAT).alias(f.name)
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, partition_by=()) -> None:
    writer = records(df).write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_json(df: DataFrame, path: str, partition_by=()) -> None:
    writer = records(df).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> dict[str, str]:
    """Writes named result tables below `folder`, partitioned by generator where there is one.

    Returns name -> path. Tables that only feed other tables are not materialised twice.
    """
    write = {"csv": write_csv, "json": write_json, "parquet": write_parquet}[fmt]
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        keys = [c for c in ("architecture",) if c in df.columns and len(df.columns) > 1]
        write(df, paths[name], keys)
    return paths
