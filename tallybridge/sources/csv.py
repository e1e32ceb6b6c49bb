"""CSV files with the usual missing-value tokens and inferred types."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stored import Workspace

# Cell texts that mean "missing", the default list of the pandas CSV reader.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Texts of booleans and numbers, as the same reader recognises them.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|Inf|INF|infinity|Infinity)\s*$"

MISFIT = "_misfit"
CSV_NAMES = "*.[cC][sS][vV]"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read one CSV file: header row, missing tokens to NULL, inferred column types.

    Dates stay text. A line with more fields than the header is an error rather than
    cut. The file is split over tasks unless a quoted cell may hold a line break, which
    a count of quotes per line finds out.
    """
    reader = spark.read.options(
        quote='"', escape='"', multiLine=_may_break_lines_in_cells(spark, path), header=False
    )
    header = reader.csv(path).first()
    if header is None:
        raise ValueError(f"no columns in {path}")
    fields = _fields(len(header))
    raw = _raw(reader, fields).csv(path)
    seen = raw.select(*_cells(fields), MISFIT).agg(*_type_counts(fields)).first()
    return _typed(raw, path, list(header), seen)


def describe_csv_folder(
    spark: SparkSession, folder: str, suffix: str | None, workspace: Workspace
) -> DataFrame | None:
    """What ``read_described_csv`` needs of all CSV files below a folder, one row by ``path``, in a number of jobs that
    does not grow with them; None without such files.

    One pass over the lines finds the header of every file and whether its cells may hold line breaks; one more
    over the cells, for the files of either kind, counts what types its columns can have. Both are aggregated by file. A file whose
    header goes over several lines is left out, and so is one without a line: they are for ``read_csv``.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": CSV_NAMES}
    file = F.col("_metadata.file_path").alias("path")
    wanted = F.lit(True) if suffix is None else F.col("path").endswith(suffix)
    # A line's place: its block in the file, then the running number in the task that reads the block.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.options(**options).text(folder).select("value", file, place.alias("place")).where(wanted)
    filled = F.col("value").rlike(r"[^\x00-\x20]")
    heads = lines.groupBy("path").agg(
        F.min_by("value", "place").alias("first"),
        F.min_by(F.when(filled, F.col("value")), F.when(filled, F.col("place"))).alias("header"),
        (F.max(_quotes(F.col("value")) % 2) > 0).alias("breaks"),
    )
    whole = (_quotes(F.col("header")) % 2 == 0) & (~F.col("breaks") | (F.col("first") == F.col("header")))
    heads = workspace.store(heads.where(whole).drop("first"))
    width = F.max(_separators(F.col("header")) + 1).alias("width")
    facts = heads.agg(width, F.bool_or("breaks").alias("some"), F.bool_and("breaks").alias("all")).first()
    if facts["width"] is None:
        return None
    widest, counts = _fields(facts["width"]), None
    for breaks in sorted({facts["some"], facts["all"]}):
        reader = spark.read.options(quote='"', escape='"', multiLine=breaks)
        # Lines of narrower files are misfits here; only one with more cells than its own header is in excess.
        cells = _raw(reader, widest).options(**options).csv(folder).select(*_cells(widest), MISFIT, file)
        cells = cells.join(F.broadcast(heads.where(F.col("breaks") == breaks).select("path")), "path", "left_semi")
        part = cells.groupBy("path").agg(*_type_counts(widest))
        counts = part if counts is None else counts.unionAll(part)
    return heads.join(F.broadcast(counts), "path", "left")  # one row per file


def read_described_csv(spark: SparkSession, path: str, seen: Row) -> DataFrame:
    """One CSV file, as ``read_csv`` reads it, without a job."""
    header = next(csv.reader([seen["header"]]))
    reader = spark.read.options(quote='"', escape='"', multiLine=seen["breaks"])
    return _typed(_raw(reader, _fields(len(header))).csv(no_glob(path)), path, header, seen)


def no_glob(path: str) -> str:
    """Readers take patterns: escape the characters that would make a name one."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def _fields(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


def _raw(reader: DataFrameReader, fields: Sequence[str]) -> DataFrameReader:
    """Text cells; a line with more or fewer fields than the header is put into MISFIT too."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*fields, MISFIT]])
    return reader.options(header=True, columnNameOfCorruptRecord=MISFIT).schema(schema)


def _cells(fields: Sequence[str]) -> list[Column]:
    return [F.when(~F.col(c).isin(MISSING_TOKENS), F.col(c)).alias(c) for c in fields]


def _typed(raw: DataFrame, path: str, header: Sequence[str | None], seen: Row) -> DataFrame:
    fields = _fields(len(header))
    types, overflow = _types(seen, fields)
    if overflow:
        raise ValueError(f"{path} has lines with more fields than its header")
    typed = [typed_cell(F.col(c), types[c]).alias(c) for c in fields]
    return raw.select(*_cells(fields)).select(*typed).toDF(*_distinct_names(header))


def _separators(line: Column) -> Column:
    """Commas of a line that are not inside quotes."""
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))


def _may_break_lines_in_cells(spark: SparkSession, path: str) -> bool:
    """True if some line has an odd number of quotes, so that a cell may go on after it."""
    lines = spark.read.text(path)
    return bool(lines.agg(F.max(_quotes(F.col("value")) % 2)).first()[0])


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _distinct_names(header: Sequence[str | None]) -> list[str]:
    """Header names: blanks are numbered, repeated names get .1, .2, …"""
    names: list[str] = []
    for i, name in enumerate(header):
        name = f"Unnamed: {i}" if name is None or name == "" else name
        candidate, n = name, 0
        while candidate in names:
            n += 1
            candidate = f"{name}.{n}"
        names.append(candidate)
    return names


def _type_counts(fields: Sequence[str]) -> list[Column]:
    """Over text cells and MISFIT: the rows, the most separators of a misfit, and per column how many cells look like what."""
    aggregates = [F.count(F.lit(1)).alias("rows"), F.max(_separators(F.col(MISFIT))).alias("separators")]
    for c in fields:
        col = F.col(c)
        integer = col.rlike(INTEGER)
        aggregates += [
            F.count(col).alias(f"present_{c}"),
            F.count_if(integer).alias(f"integer_{c}"),
            F.count_if(integer & col.try_cast("bigint").isNull()).alias(f"too_long_{c}"),
            F.count_if(col.rlike(NUMBER)).alias(f"number_{c}"),
            F.count_if(col.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"boolean_{c}"),
        ]
    return aggregates


def _types(seen: Row, fields: Sequence[str]) -> tuple[dict[str, T.DataType], bool]:
    """Column types from those counts, and whether lines overflow.

    Whole numbers are bigint only in a column without missing cells, else double.
    """
    types: dict[str, T.DataType] = {}
    for c in fields:
        present = seen[f"present_{c}"]
        if not seen["rows"]:
            types[c] = T.StringType()
        elif present == 0:
            types[c] = T.DoubleType()
        elif seen[f"too_long_{c}"]:
            types[c] = T.StringType()
        elif seen[f"integer_{c}"] == seen["rows"]:
            types[c] = T.LongType()
        elif seen[f"number_{c}"] == present:
            types[c] = T.DoubleType()
        elif seen[f"boolean_{c}"] == present:
            types[c] = T.BooleanType()
        else:
            types[c] = T.StringType()
    return types, (seen["separators"] or 0) >= len(fields)


def typed_cell(cell: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return cell
    if isinstance(dtype, T.BooleanType):
        return F.when(cell.isNotNull(), cell.isin(TRUE_TOKENS))
    return F.trim(cell).cast(dtype)
