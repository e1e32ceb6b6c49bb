"""Load files and folders into named DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stored import Workspace
from .csv import describe_csv_folder, no_glob, read_csv, read_described_csv
from .json import read_json
from .workbook import read_workbook

MANIFEST = "path string, name string, status string, error string"


def _legacy_workbook(spark: SparkSession, path: str) -> DataFrame:
    raise ValueError("the legacy binary .xls format is not read; save the workbook as .xlsx")


READERS = {"csv": read_csv, "json": read_json, "xlsx": read_workbook, "xls": _legacy_workbook}


@dataclass
class LoadResult:
    """Named lazy frames, and what happened to each file."""

    spark: SparkSession
    frames: dict[str, DataFrame] = field(default_factory=dict)
    files: list[tuple[str, str | None, str, str | None]] = field(default_factory=list)

    def manifest(self) -> DataFrame:
        """One row per file: path, name, status (loaded, renamed or failed), error."""
        return self.spark.createDataFrame(self.files, MANIFEST)

    def preview(self, rows: int = 5) -> DataFrame:
        """The first rows of every frame as JSON: name, row_json."""
        shown = self.spark.createDataFrame([], "name string, row_json string")
        for name, df in self.frames.items():
            cells = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
            as_json = F.to_json(cells, {"ignoreNullFields": "false"}).alias("row_json")
            shown = shown.unionAll(df.limit(rows).select(F.lit(name).alias("name"), as_json))
        return shown


def dataset_name(path: str) -> str:
    """``<stem before the first dot>_<extension>df``"""
    file = path.rstrip("/").rsplit("/", 1)[-1]
    return f"{file.split('.')[0]}_{extension_of(path)}df"


def extension_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


def load_files(
    spark: SparkSession,
    folder: str | None = None,
    extension: str | None = None,
    path: str | None = None,
) -> LoadResult:
    """Load a folder (recursively; optionally only names ending in ``extension``) or a file.

    A file that cannot be read is reported in the manifest and the others load.
    """
    if path is not None and folder is None and extension is None:
        if extension_of(path) not in READERS:
            raise ValueError(f"unsupported file type: {extension_of(path)}")
        return _load(spark, [path])
    if folder is None or path is not None:
        raise ValueError("give a folder, a folder and an extension, or a path")
    workspace = Workspace(spark)
    try:
        listed = _listed(spark, folder, extension, describe_csv_folder(spark, folder, extension, workspace))
    except Exception:  # one unreadable file fails the pass over all of them: each tells its own error then
        listed = _listed(spark, folder, extension)
    finally:
        workspace.drop()
    known = {r["path"]: r for r in listed if "header" in r and r["header"] is not None}
    return _load(spark, [r["path"] for r in listed if extension_of(r["path"]) in READERS], known)


def list_files(spark: SparkSession, folder: str, suffix: str | None = None) -> list[str]:
    """Paths below a folder in name order; ``suffix`` is compared with case. Only file
    names reach the driver: the content column is never read. Spark's scans pass over files without a byte."""
    return [r["path"] for r in _listed(spark, folder, suffix)]


def _listed(
    spark: SparkSession, folder: str, suffix: str | None, described: DataFrame | None = None
) -> list[Row]:
    """One row per file, with what is known of it."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    )
    if suffix is not None:
        files = files.where(F.col("path").endswith(suffix))
    if described is not None:
        files = files.join(F.broadcast(described), "path", "left")  # one row per file
    return sorted(files.collect(), key=lambda r: r["path"])


def _load(
    spark: SparkSession, paths: list[str], known: Mapping[str, Row] | None = None
) -> LoadResult:
    result = LoadResult(spark)
    for path in paths:
        name, status = dataset_name(path), "loaded"
        try:
            if known and path in known:
                df = read_described_csv(spark, path, known[path])
            else:
                df = READERS[extension_of(path)](spark, no_glob(path))
        except Exception as error:  # any unreadable file: report it, load the rest
            result.files.append((path, None, "failed", str(error)))
            continue
        if name in result.frames:
            name, status = _free_name(name, path, result.frames), "renamed"
        result.frames[name] = df
        result.files.append((path, name, status, None))
    return result


def _free_name(name: str, path: str, taken: dict[str, DataFrame]) -> str:
    parents = path.split("/")[:-1]
    candidate = f"{name}_{parents[-1]}" if parents else name
    number = 2
    while candidate in taken:
        candidate = f"{name}_{parents[-1] if parents else ''}_{number}"
        number += 1
    return candidate


def with_row_index(scan: DataFrame, name: str = "_row_idx") -> DataFrame:
    """Number the rows of a frame read directly from files, by file name and position.

    A task reads a file block as a whole and in order, so a row's place in its block follows from the running
    number of its task; no row is sorted. Blocks are offset by the rows before them, in two steps: blocks
    within their file, and files within all. Only one count per block is brought together, and one per file.
    """
    blocks = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )
    counts = blocks.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")
    )
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
    files = counts.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    # One number per file, in the order of their names.
    in_order = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_rows").over(in_order), F.lit(0)).alias("_before"))
    offsets = starts.join(files, "_file").select(
        "_file", "_block", (F.col("_before") + F.col("_start") - F.col("_first")).alias("_offset")
    )
    return (
        blocks.join(offsets, ["_file", "_block"])
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_file", "_block", "_place", "_offset")
    )


def first_rows(df: DataFrame, n: int, order_by: str = "_row_idx") -> DataFrame:
    """The first ``n`` rows by position."""
    return df.orderBy(order_by).limit(n)
