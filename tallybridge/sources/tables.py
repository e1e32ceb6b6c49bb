"""Catalog tables: read, list, keys, write."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quote_identifier
from ..operators.columns import unique_column

KEY_PROPERTY = "primary_key"
UNIQUE_PROPERTY = "unique_columns"
KEY_COLUMN_USAGE = "CONSTRAINT_NAME string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int"
TABLE_CONSTRAINTS = "CONSTRAINT_NAME string, TABLE_NAME string, CONSTRAINT_TYPE string"


def qualified(table: str, database: str | None = None) -> str:
    name = quote_identifier(table)
    return name if database is None else f"{quote_identifier(database)}.{name}"


def select(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    return spark.table(qualified(table, database))


def show_tables(spark: SparkSession, database: str) -> DataFrame:
    tables = spark.sql(f"SHOW TABLES IN {quote_identifier(database)}")
    return tables.where(~F.col("isTemporary")).select(F.col("tableName").alias("table_name"))


def declare_key(
    spark: SparkSession, table: str, columns: Sequence[str], database: str | None = None
) -> None:
    """Record key columns with a table; the built-in catalog has no constraints of its own."""
    _declare(spark, table, columns, database, KEY_PROPERTY)


def declare_unique(
    spark: SparkSession, table: str, columns: Sequence[str], database: str | None = None
) -> None:
    """Record columns that are unique together but not the key."""
    _declare(spark, table, columns, database, UNIQUE_PROPERTY)


def _declare(spark, table, columns, database, name) -> None:
    text = ",".join(quote_identifier(c) for c in columns).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {qualified(table, database)} SET TBLPROPERTIES ('{name}' = '{text}')")


def constraints(spark: SparkSession, database: str) -> tuple[DataFrame, DataFrame]:
    """What a database's tables declare, shaped like the standard's views: the columns of every
    constraint with their places, and every constraint with its type. One row per declared column, read
    from the catalog table by table; no data is read."""
    columns, found = [], []
    for table in spark.catalog.listTables(quote_identifier(database)):
        if table.isTemporary:
            continue
        for name, kind, short in ((KEY_PROPERTY, "PRIMARY KEY", "pk"), (UNIQUE_PROPERTY, "UNIQUE", "uq")):
            declared = _declared(spark, table.name, database, name)
            if declared:
                constraint = f"{short}_{table.name}"
                found.append((constraint, table.name, kind))
                columns += [(constraint, table.name, c, i) for i, c in enumerate(declared, 1)]
    return spark.createDataFrame(columns, KEY_COLUMN_USAGE), spark.createDataFrame(found, TABLE_CONSTRAINTS)


def key_columns(columns: DataFrame, constraints: DataFrame, table: str | None = None) -> DataFrame:
    """``(table_name, column_name, place)`` of primary keys: the constraints' columns semi-joined with those
    that are primary keys. The standard lets two tables give their constraints the same name."""
    primary = constraints.where("CONSTRAINT_TYPE = 'PRIMARY KEY'")
    if table is not None:
        columns, primary = (df.where(F.col("TABLE_NAME") == table) for df in (columns, primary))
    return columns.join(primary, ["TABLE_NAME", "CONSTRAINT_NAME"], "left_semi").select(
        F.col("TABLE_NAME").alias("table_name"),
        F.col("COLUMN_NAME").alias("column_name"),
        F.col("ORDINAL_POSITION").alias("place"),
    )


def declared_key(spark: SparkSession, table: str, database: str | None = None) -> list[str]:
    """All declared key columns, in order; empty without a declaration."""
    return _declared(spark, table, database, KEY_PROPERTY)


def _declared(spark: SparkSession, table: str, database: str | None, name: str) -> list[str]:
    properties = spark.sql(f"SHOW TBLPROPERTIES {qualified(table, database)}")
    found = properties.where(F.col("key") == name).first()
    return [] if found is None else _declared_names(found["value"])


def _declared_names(text: str) -> list[str]:
    """Names parted by commas; those in backticks may hold commas, and backticks twice."""
    quoted = r"\s*(?:`((?:[^`]|``)*)`|([^,`]*))\s*(?:,|$)"
    names = [a.replace("``", "`") or b.strip() for a, b in re.findall(quoted, text)]
    return [n for n in names if n]


def discover_key(spark: SparkSession, table: str, database: str | None = None) -> tuple[list[str], str]:
    """The key of a table and where it comes from: declared, then a unique column, then none."""
    declared = declared_key(spark, table, database)
    if declared:
        return declared, "key"
    column = unique_column(select(spark, table, database))
    return ([column], "assumed_key") if column else ([], "no_key")


def use_database(
    spark: SparkSession, database: str, mode: str, location: str | None = None
) -> str:
    """Make sure of the target database: ``new`` creates it if absent, ``existing`` needs it."""
    if mode == "new":
        statement = f"CREATE DATABASE IF NOT EXISTS {quote_identifier(database)}"
        if location is not None:
            statement += " LOCATION '" + location.replace("\\", "\\\\").replace("'", "\\'") + "'"
        spark.sql(statement)
    elif mode == "existing":
        if not spark.catalog.databaseExists(database):
            raise ValueError(f"database {database!r} does not exist")
    else:
        raise ValueError("mode must be 'new' or 'existing'")
    return database


def write_table(df: DataFrame, table: str, database: str | None = None, fmt: str = "parquet") -> None:
    """Replace a table by a frame."""
    df.write.mode("overwrite").format(fmt).saveAsTable(qualified(table, database))


# Properties that belong to one table's files, not to its definition.
OWN_PROPERTIES = ("transient_lastDdlTime", "numFiles", "numRows", "totalSize", "rawDataSize")


@dataclass
class Definition:
    """What a table is besides its rows, as far as a frame with other columns can have it too."""

    fmt: str
    partitions: list[str]
    buckets: int
    bucket_columns: list[str]
    properties: dict[str, str]
    comment: str | None
    column_comments: dict[str, str]


def definition(spark: SparkSession, table: str, database: str | None = None) -> Definition:
    target = qualified(table, database)
    columns = spark.catalog.listColumns(target)
    details = spark.sql(f"DESCRIBE TABLE EXTENDED {target}").where(
        F.col("col_name").isin("Provider", "Num Buckets")
    )
    told = details.agg(
        F.max(F.when(F.col("col_name") == "Provider", F.col("data_type"))).alias("fmt"),
        F.max(F.when(F.col("col_name") == "Num Buckets", F.col("data_type"))).alias("buckets"),
    ).first()
    properties = spark.sql(f"SHOW TBLPROPERTIES {target}").where(~F.col("key").isin(*OWN_PROPERTIES))
    entries = properties.agg(F.map_from_entries(F.array_agg(F.struct("key", "value"))).alias("p")).first()["p"]
    return Definition(
        told["fmt"] or "parquet",
        [c.name for c in columns if c.isPartition],
        int(told["buckets"] or 0),
        [c.name for c in columns if c.isBucket],
        entries or {},
        spark.catalog.getTable(target).description,
        {c.name: c.description for c in columns if c.description},
    )


def _define(spark: SparkSession, name: str, like: Definition, columns: Sequence[str]) -> None:
    """Give a table the properties and comments of another one."""

    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    for key, value in like.properties.items():
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({text(key)} = {text(value)})")
    if like.comment:
        spark.sql(f"COMMENT ON TABLE {name} IS {text(like.comment)}")
    for column, comment in like.column_comments.items():
        if column in columns:
            spark.sql(f"ALTER TABLE {name} ALTER COLUMN {quote_identifier(column)} COMMENT {text(comment)}")


def replace_table(df: DataFrame, table: str, database: str | None = None, fmt: str | None = None) -> None:
    """Replace a table that ``df`` itself may be reading: write beside it, then swap names.

    The new table keeps the format (unless ``fmt`` names one), partitioning, buckets, properties and comments of the
    old one, as far as ``df`` has the columns. The old table keeps its data until the new one is complete; a
    swap that fails half way is undone. Names beside the table's are fresh, so no table of a user's is touched.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:12]
    target = qualified(table, database)
    staged, retired = (qualified(f"{table}__{kind}_{mark}", database) for kind in ("new", "old"))
    if not spark.catalog.tableExists(target):
        df.write.mode("error").format(fmt or "parquet").saveAsTable(staged)
        spark.sql(f"ALTER TABLE {staged} RENAME TO {target}")
        return
    like, has = definition(spark, table, database), set(df.columns)
    writer = df.write.mode("error").format(fmt or like.fmt)
    partitioned = bool(like.partitions) and set(like.partitions) < has
    if partitioned:
        writer = writer.partitionBy(*like.partitions)
    if like.buckets and set(like.bucket_columns) <= has:
        writer = writer.bucketBy(like.buckets, *like.bucket_columns)
    if not set(declared_key(spark, table, database)) <= has:
        like.properties.pop(KEY_PROPERTY, None)
    writer.saveAsTable(staged)
    try:
        _define(spark, staged, like, df.columns)
        _rename(spark, target, retired, bool(like.partitions))
    except Exception:
        spark.sql(f"DROP TABLE {staged}")
        raise
    try:
        _rename(spark, staged, target, partitioned)
    except Exception:
        _rename(spark, retired, target, bool(like.partitions))
        spark.sql(f"DROP TABLE {staged}")
        raise
    spark.sql(f"DROP TABLE {retired}")


def _rename(spark: SparkSession, name: str, to: str, partitioned: bool) -> None:
    """Rename a table; not every catalog moves the places of its partitions along, so these are looked up anew."""
    spark.sql(f"ALTER TABLE {name} RENAME TO {to}")
    if partitioned:
        spark.sql(f"MSCK REPAIR TABLE {to} SYNC PARTITIONS")
