"""Writing and reading tables in the file formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch


def round_trip(df: DataFrame, fmt: str, write: dict | None = None, read: dict | None = None) -> DataFrame:
    """Write ``df`` in a format to the shared folder and read it back with the same schema."""
    path = scratch(df.sparkSession, fmt)
    df.write.format(fmt).options(**(write or {})).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).options(**(read or write or {})).load(path)


def table_name(label: str) -> str:
    return f"tidemark_{label}_{uuid.uuid4().hex}"


def saved_table(df: DataFrame, label: str, partition: str | None = None, bucket: tuple[int, str] | None = None) -> str:
    """Save as a catalog table whose files lie in the shared folder; returns its name."""
    name = table_name(label)
    writer = df.write.format("parquet").option("path", scratch(df.sparkSession, label))
    if partition:
        writer = writer.partitionBy(partition)
    if bucket:
        writer = writer.bucketBy(*bucket).sortBy(bucket[1])
    writer.saveAsTable(name)
    return name


def without_header_and_footer(lines: DataFrame, header: str, footer: str) -> DataFrame:
    """Drop the header and footer lines that each file of a text table carries."""
    return lines.where(~F.col("value").startswith(header) & ~F.col("value").startswith(footer))
