"""Write many named frames into a database, with the outcome per table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import safe_table_name
from ..sources import jdbc, tables

MANIFEST = (
    "name string, table_name string, rows_read bigint, rows_written bigint, status string, error string"
)


def migrate(
    spark: SparkSession, frames: Mapping[str, DataFrame], database: str, mode: str = "new"
) -> DataFrame:
    """Replace one table per frame. Returns a row per frame with counts and status.

    A frame that cannot be written is reported and the rest go on. The rows of the
    written table are counted and must equal the rows of the frame.
    """
    tables.use_database(spark, database, mode)
    return _migrate(
        spark,
        frames,
        write=lambda df, table: tables.write_table(df, table, database),
        read=lambda table: tables.select(spark, table, database),
    )


def migrate_jdbc(
    spark: SparkSession, frames: Mapping[str, DataFrame], options: Mapping[str, str]
) -> DataFrame:
    """The same into an external database."""
    return _migrate(
        spark,
        frames,
        write=lambda df, table: jdbc.write_table(df, options, table),
        read=lambda table: jdbc.select(spark, options, table),
    )


def _migrate(
    spark: SparkSession,
    frames: Mapping[str, DataFrame],
    write: Callable[[DataFrame, str], None],
    read: Callable[[str], DataFrame],
) -> DataFrame:
    outcome, taken = [], set()
    for name, df in frames.items():
        table = _free(safe_table_name(name), taken)
        taken.add(table.lower())
        try:
            write(df, table)
            before, after = df.count(), read(table).count()
            status = "written" if before == after else "incomplete"
            outcome.append((name, table, before, after, status, None))
        except Exception as error:  # any frame that cannot be written: report it, write the rest
            outcome.append((name, table, None, None, "failed", str(error)))
    return spark.createDataFrame(outcome, MANIFEST)


def _free(table: str, taken: set[str]) -> str:
    """Two names may become one table name; catalogs ignore case."""
    candidate, number = table, 2
    while candidate.lower() in taken:
        candidate = f"{table}_{number}"
        number += 1
    return candidate
