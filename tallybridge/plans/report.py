"""Write a comparison: report tables, JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import NESTED, quoted
from .compare import Diff

FORMATS = ("parquet", "orc", "json", "csv")


def with_placeholder(df: DataFrame, table: str) -> DataFrame:
    """The table, or one row saying that it has none."""
    if not df.isEmpty():
        return df
    message = [(f"There are no records in {table}",)]
    return df.sparkSession.createDataFrame(message, "Message string")


def nested_to_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for sinks that know only flat types."""
    if not any(isinstance(f.dataType, NESTED) for f in df.schema):
        return df
    return df.select(
        *[
            (F.to_json(quoted(f.name)) if isinstance(f.dataType, NESTED) else quoted(f.name)).alias(f.name)
            for f in df.schema
        ]
    )


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write one table in a file format; nested cells become JSON text in CSV."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    writer = (nested_to_json(df) if fmt == "csv" else df).write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(fmt).save(path)


def write_report(
    diff: Diff, path: str, fmt: str = "parquet", *, placeholder: bool = False
) -> dict[str, str]:
    """Write the eight report tables below ``path``; returns their locations by name."""
    diff.store()
    written = {}
    for name, df in diff.tables().items():
        location = f"{path.rstrip('/')}/{name}"
        write_files(with_placeholder(df, name) if placeholder else df, location, fmt)
        written[name] = location
    return written


def write_json(diff: Diff, path: str) -> dict[str, str]:
    """The whole comparison as JSON records, one folder per category."""
    diff.store()
    parts = {
        "added_columns": diff.columns_only_in_target(),
        "deleted_columns": diff.columns_only_in_source(),
        "added_rows": diff.added_rows(),
        "deleted_rows": diff.deleted_rows(),
        "updated_rows_details": diff.updated_details(),
        "duplicate_rows_in_source": diff.duplicates_in_source(),
        "duplicate_rows_in_target": diff.duplicates_in_target(),
        "summary": diff.summary(),
    }
    if diff.key:
        parts["updated_rows"] = diff.updated_rows()
    written = {}
    for name, df in parts.items():
        written[name] = f"{path.rstrip('/')}/{name}"
        write_files(df, written[name], "json")
    return written
