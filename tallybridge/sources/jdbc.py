"""Tables of an external database. Connection options come from the caller."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import quoted
from ..functions.text import quote_identifier
from ..plans.report import nested_to_json
from . import tables

Options = Mapping[str, str]
# Views of the SQL standard's information schema.
TABLES = "INFORMATION_SCHEMA.TABLES"
KEY_COLUMNS = "INFORMATION_SCHEMA.KEY_COLUMN_USAGE"
CONSTRAINTS = "INFORMATION_SCHEMA.TABLE_CONSTRAINTS"


def checked(name: str) -> str:
    quote_identifier(name)
    return name


def read_options(
    options: Options,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
) -> dict[str, str]:
    """Reader options; with a partition column the table is read by parallel range queries."""
    wanted = {**options, "dbtable": checked(table)}
    if partition_column is not None and bounds is not None and bounds[0] is not None:
        wanted |= {
            "partitionColumn": checked(partition_column),
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return wanted


def select(
    spark: SparkSession,
    options: Options,
    table: str,
    partition_column: str | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A whole table. The range of the partition column is asked of the database first."""
    def whole(**more):
        return spark.read.format("jdbc").options(**read_options(options, table, **more)).load()

    if partition_column is None:
        return whole()
    column = quoted(partition_column)
    bounds = whole().agg(F.min(column), F.max(column)).first()
    return whole(partition_column=partition_column, bounds=tuple(bounds), partitions=partitions)


def show_tables(spark: SparkSession, options: Options, view: str = TABLES) -> DataFrame:
    tables = spark.read.format("jdbc").options(**options, dbtable=view).load()
    return tables.select(F.col("TABLE_NAME").alias("table_name"))


def key_columns(columns: DataFrame, constraints: DataFrame, table: str) -> DataFrame:
    """Key columns of a table, in order: key-column usage restricted to primary keys."""
    return tables.key_columns(columns, constraints, table).orderBy("place").select("column_name")


def declared_key(
    spark: SparkSession,
    options: Options,
    table: str,
    columns_view: str = KEY_COLUMNS,
    constraints_view: str = CONSTRAINTS,
) -> list[str]:
    """All declared key columns of a table in the external database."""
    reader = spark.read.format("jdbc").options(**options)
    keys = key_columns(
        reader.option("dbtable", columns_view).load(),
        reader.option("dbtable", constraints_view).load(),
        table,
    )
    return [r["column_name"] for r in keys.collect()]


def write_table(df: DataFrame, options: Options, table: str) -> None:
    """Replace a table; nested cells, which such databases do not take, become JSON text."""
    flat = nested_to_json(df)
    flat.write.format("jdbc").options(**options, dbtable=checked(table)).mode("overwrite").save()
